"""Exact nearest neighbours and the upkeep of a vector table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import squared_l2
from .ordered import numbered

#: Queries and vectors that meet in one task of knn, at most.
QUERY_BLOCK, VECTOR_BLOCK = 4096, 50_000


def top_k(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", embedding: str = "embedding", where=None) -> DataFrame:
    """The k nearest vectors to one query, by squared distance, then id: a scan and a top-k, no shuffle of vectors.

    ``where`` filters before the search; filters on the result come after it and may leave fewer than k.
    """
    rows = vectors.where(where) if where is not None else vectors
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("distance", squared_l2(F.col(embedding), q)).orderBy("distance", id_col).limit(k)


def knn(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, vec_id, distance, rank) of the k nearest vectors to each query, exactly.

    A block join on the executors: queries are cut into blocks of at most QUERY_BLOCK and vectors into blocks of at most
    VECTOR_BLOCK by the hash of their id, and every block of queries meets every block of vectors in a task of its
    own, which keeps the k best per query; the driver sees neither.  Null embeddings are skipped.
    """
    def blocks(df, size, name):
        n = max(1, -(-df.count() // size))
        return df.withColumn(name, F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")), n

    q, nq = blocks(queries.select(F.col(id_col).cast("bigint").alias(id_col), embedding).where(f"{embedding} IS NOT NULL"), QUERY_BLOCK, "qb")
    v, nv = blocks(vectors.select(F.col(id_col).cast("bigint").alias(id_col), embedding).where(f"{embedding} IS NOT NULL"), VECTOR_BLOCK, "vb")
    q = q.withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(nv - 1))))
    v = v.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def near(left, right):
        import numpy as np
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "distance": []})
        ids, vid = left[id_col].to_numpy(), right[id_col].to_numpy()
        a, b = np.stack(left[embedding].to_list()).astype("float64"), np.stack(right[embedding].to_list()).astype("float64")
        out = []
        for at in range(0, len(a), 512):
            x = a[at : at + 512]
            d = ((x**2).sum(1)[:, None] - 2 * x @ b.T + (b**2).sum(1)[None, :]).clip(0)
            n = min(k, len(vid))
            edge = np.partition(d, n - 1, axis=1)[:, n - 1]
            # ties at the edge stay in: the final ranking decides by id
            qi, vi = np.nonzero(d <= edge[:, None] * (1 + 1e-9) + 1e-9)
            out.append(pd.DataFrame({"query_id": ids[at + qi], "vec_id": vid[vi], "distance": ((x[qi] - b[vi]) ** 2).sum(1)}))
        return pd.concat(out)

    found = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(near, "query_id BIGINT, vec_id BIGINT, distance DOUBLE")
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cluster_of_best(vectors: DataFrame, query: list[float], members: DataFrame, n_clusters: int = 1) -> DataFrame:
    """All members of the clusters whose vector is nearest, each with its cluster's distance.

    vectors(cluster_id, embedding), members(cluster_id, chunk_id); clusters without members are passed over.
    """
    existing = vectors.join(members.select("cluster_id").distinct(), "cluster_id", "left_semi")
    best = top_k(existing, query, n_clusters, "cluster_id").select("cluster_id", "distance")
    return members.join(F.broadcast(best), "cluster_id")


def hits_to_files(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Files of vector hits: a chunk's own file, a cluster's files through its chunks.

    hits(id, type, chunk_ids, distance), docs(chunk_id, file_path).
    """
    chunk = F.explode(F.when(F.col("type") == "cluster", F.col("chunk_ids")).otherwise(F.array("id")))
    return hits.withColumn("chunk_id", chunk).join(docs, "chunk_id", "left").where("file_path IS NOT NULL").groupBy("file_path").agg(F.min("distance").alias("distance"))


def add_vectors(store: DataFrame, new: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """The store with new vectors numbered from its greatest id + 1, in the order of their ref_id (I8)."""
    top = store.agg(F.coalesce(F.max(id_col), F.lit(-1)).alias("top"))
    added = numbered(new, [F.col("ref_id")], "n").join(F.broadcast(top)).withColumn(id_col, F.col("top") + F.col("n")).drop("n", "top")
    return store.unionByName(added, allowMissingColumns=True)


def apply_deletes(store: DataFrame, deleted: DataFrame, ref: str = "ref_id") -> DataFrame:
    """The store without the vectors of deleted documents, as when it is persisted."""
    return store.join(deleted.select(ref).distinct(), ref, "left_anti")


def ingest_diff(old: DataFrame, new: DataFrame, key: list[str], hash_col: str = "hash") -> DataFrame:
    """(key, action): insert, update, delete or unchanged by comparing content hashes."""
    o = old.select(*key, F.col(hash_col).alias("old_hash")).withColumn("in_old", F.lit(True))
    n = new.select(*key, F.col(hash_col).alias("new_hash")).withColumn("in_new", F.lit(True))
    action = F.when(F.col("in_old").isNull(), "insert").when(F.col("in_new").isNull(), "delete").when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "unchanged").otherwise("update")
    return o.join(n, key, "full_outer").select(*key, action.alias("action"))
