"""Set operations, edits and comparisons of tables: moves, merges, missing items, upserts (I and N families)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def missing(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Expected rows without a match."""
    return expected.join(actual.select(*keys).distinct(), keys, "left_anti")


def all_found(expected: DataFrame, actual: DataFrame, instance: str, keys: list[str]) -> DataFrame:
    """Per instance whether every expected item is there."""
    got = actual.select(instance, *keys).distinct().withColumn("hit", F.lit(True))
    return expected.join(got, [instance, *keys], "left").groupBy(instance).agg(F.every(F.coalesce("hit", F.lit(False))).alias("all_found"))


def changed(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, change): added, removed or changed items between two versions."""
    o, n = old.select(*keys, F.col(value).alias("__o"), F.lit(1).alias("__in_old")), new.select(*keys, F.col(value).alias("__n"), F.lit(1).alias("__in_new"))
    change = F.when(F.col("__in_old").isNull(), "added").when(F.col("__in_new").isNull(), "removed").when(~F.col("__o").eqNullSafe(F.col("__n")), "changed")
    return o.join(n, keys, "full_outer").select(*keys, change.alias("change")).where("change IS NOT NULL")


def conflict_free(ops: DataFrame, keys: list[str], kind: str = "op_type", move: str = "MoveOp") -> DataFrame:
    """Operations without the moves that collide: those whose keys occur in more than one move."""
    n = F.count_if(F.col(kind) == move).over(Window.partitionBy(*keys))
    return ops.withColumn("__n", n).where((F.col(kind) != move) | (F.col("__n") == 1)).drop("__n")


def moved(members: DataFrame, moves: DataFrame, clusters: DataFrame) -> DataFrame:
    """Membership after moves(chunk_id, src_cluster, dst_cluster); moves between unknown clusters are skipped.

    The old edge goes if it is there, the new one comes.
    """
    known = clusters.select("cluster_id").distinct()
    valid = moves.join(known.withColumnRenamed("cluster_id", "src_cluster"), "src_cluster", "left_semi").join(known.withColumnRenamed("cluster_id", "dst_cluster"), "dst_cluster", "left_semi")
    kept = members.join(valid.select("chunk_id", F.col("src_cluster").alias("cluster_id")), ["chunk_id", "cluster_id"], "left_anti")
    return kept.select("chunk_id", "cluster_id").unionByName(valid.select("chunk_id", F.col("dst_cluster").alias("cluster_id"))).distinct()


def adopted(tree: DataFrame, adoptions: DataFrame, clusters: DataFrame) -> DataFrame:
    """Parent links after adoptions(child_id, parent_id); unknown clusters and existing links change nothing."""
    known = clusters.select("cluster_id").distinct()
    valid = adoptions.join(known.withColumnRenamed("cluster_id", "child_id"), "child_id", "left_semi").join(known.withColumnRenamed("cluster_id", "parent_id"), "parent_id", "left_semi")
    return tree.select("child_id", "parent_id").unionByName(valid.select("child_id", "parent_id")).distinct()


def created(clusters: DataFrame, new: DataFrame) -> DataFrame:
    """Clusters with new ones (I3); an id that exists stays as it is."""
    return clusters.unionByName(new.join(clusters.select("cluster_id"), "cluster_id", "left_anti"), allowMissingColumns=True)


def split_members(members: DataFrame, topics: DataFrame) -> DataFrame:
    """Membership with the chunks of a cluster that topics(chunk_id, cluster_id, topic) names moved to the topic's cluster."""
    x = members.join(topics.select("chunk_id", "cluster_id", "topic"), ["chunk_id", "cluster_id"], "left")
    return x.select(
        "chunk_id", F.when(F.col("topic").isNull(), F.col("cluster_id").cast("string")).otherwise(F.concat_ws("/", F.col("cluster_id").cast("string"), "topic")).alias("cluster_id")
    )


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the latest of both."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def partial_update(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows with the non-null columns of ``new`` that they know written over."""
    shared = [c for c in new.columns if c in old.columns and c != key]
    n = new.select(key, *[F.col(c).alias(f"__{c}") for c in shared])
    return old.join(n, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in shared else F.col(c) for c in old.columns])


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames by column name; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def within_size(rows: DataFrame, least: int, most: int) -> DataFrame:
    """The rows if there are between ``least`` and ``most`` of them, else none."""
    n = rows.agg(F.count("*").alias("__n"))
    return rows.join(F.broadcast(n)).where(F.col("__n").between(least, most)).drop("__n")


def file_spans(rows: DataFrame, group: list[str], span: str) -> DataFrame:
    """Sorted distinct spans per file."""
    return rows.groupBy(*group).agg(F.sort_array(F.collect_set(span)).alias("spans"))


def residual(all_: DataFrame, rounds: list[DataFrame], keys: list[str]) -> DataFrame:
    """What no round has classified."""
    return reduce(lambda a, r: missing(a, r, keys), rounds, all_)


def balanced_groups(sizes: DataFrame, groups: int = 3, key: str = "id", size: str = "size") -> DataFrame:
    """(key, size, group): items from the largest down, each to the group that is lightest so far, the first on ties.

    A sequential fold over the items of one clustering, in one task; items are clusters, not chunks.
    """

    def run(frame):
        loads = [0] * groups
        out = []
        for _, r in frame.sort_values([size, key], ascending=[False, True]).iterrows():
            g = loads.index(min(loads))
            loads[g] += int(r[size])
            out.append(g)
        return frame.sort_values([size, key], ascending=[False, True]).assign(group=out)

    kinds = dict(sizes.dtypes)
    return sizes.select(key, size).withColumn("__one", F.lit(1)).groupBy("__one").applyInPandas(lambda f: run(f.drop(columns="__one")), f"{key} {kinds[key]}, {size} {kinds[size]}, group INT")
