"""Computations that follow an order: ordinals, closeness, budgets, caps, snapping (F family)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordinals(rows: DataFrame, group: list[str], order: list[str], name: str = "n") -> DataFrame:
    """1-based place of each row in its group (F1)."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def numbered(rows: DataFrame, order: list, name: str = "n") -> DataFrame:
    """1-based place of each row among all in a total order: one sort by range, and the sizes of its partitions as offsets."""
    from .graphs import checkpointed

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = F.lit(1 << 33)
    ranged = checkpointed(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("__p", F.floor(F.col("__m") / cut).cast("int")).withColumn("__r", F.col("__m") % cut)
    offsets, total = [], 0
    for p, n in sorted(ranged.groupBy("__p").count().collect()):
        offsets.append((p, total))
        total += n
    known = rows.sparkSession.createDataFrame(offsets, "__p INT, __o BIGINT")
    return ranged.join(F.broadcast(known), "__p").select(*rows.columns, (F.col("__o") + F.col("__r") + 1).alias(name))


def closeness_chunks(members: DataFrame, window: int = 3) -> DataFrame:
    """Per cluster the share of consecutive members whose indexes lie within the window (F2). members(cluster_id, pos, idx)."""
    w = Window.partitionBy("cluster_id").orderBy("pos")
    gap = members.withColumn("gap", F.abs(F.col("idx") - F.lag("idx").over(w)))
    return gap.groupBy("cluster_id").agg((F.count_if(F.col("gap") <= window) / F.greatest(F.count("*") - 1, F.lit(1))).alias("closeness"))


def with_prefix_bytes(inputs: DataFrame, group: list[str], idx: str = "idx", size: str = "bytes") -> DataFrame:
    """Bytes before each input in its group."""
    w = Window.partitionBy(*group).orderBy(idx)
    return inputs.withColumn("before", F.sum(size).over(w) - F.col(size))


def closeness_bytes(members: DataFrame, limit: int = 1000) -> DataFrame:
    """Per cluster the share of members that follow their anchor within ``limit`` bytes.

    members(cluster_id, pos, idx, before, bytes): a step backwards counts for nothing and leaves the anchor where it is,
    so the anchor is the greatest index so far; the bytes are those from the anchor's start, its own included, to this
    one's start, and a repeated index counts.
    """
    w = Window.partitionBy("cluster_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    anchor = F.max(F.struct("idx", "before")).over(w)
    x = members.withColumn("anchor", anchor).withColumn("ok", (F.col("idx") >= F.col("anchor.idx")) & (F.col("before") - F.col("anchor.before") <= limit))
    return x.groupBy("cluster_id").agg((F.count_if("ok") / F.count("*")).alias("closeness"))


def byte_steps(members: DataFrame) -> DataFrame:
    """Bytes between each member's start and that of the one before it in the cluster."""
    w = Window.partitionBy("cluster_id").orderBy("pos")
    return members.withColumn("step", F.abs(F.col("before") - F.lag("before").over(w))).where("step IS NOT NULL")


def ranked_budget(spans: DataFrame, group: list[str], limit: int, decay: float = 1.05, least: int = 50) -> DataFrame:
    """Tokens given to ranked spans (F5). spans(group.., rank, tokens).

    If all fit, each keeps its tokens.  Else, best rank first, spans are kept while the sum of min(tokens, least)
    stays within the limit; each gets ``least`` and its share, by decay ** -rank, of what is left, but no more than its tokens.
    """
    all_ = Window.partitionBy(*group)
    by = all_.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = F.least("tokens", F.lit(least))
    x = spans.withColumn("total", F.sum("tokens").over(all_)).withColumn("base", base).withColumn("used", F.sum(base).over(by))
    kept = x.where((F.col("total") < limit) | (F.col("used") <= limit))
    weight = F.pow(F.lit(decay), -F.col("rank"))
    kept = kept.withColumn("w", weight / F.sum(weight).over(all_)).withColumn("left", limit - F.sum("base").over(all_))
    given = F.least("tokens", F.lit(least) + F.floor(F.col("left") * F.col("w")).cast("int"))
    return kept.withColumn("given", F.when(F.col("total") < limit, F.col("tokens")).otherwise(given)).select(*group, "rank", "tokens", "given")


def context_needed(results: DataFrame, expected: DataFrame, slack: int = 1) -> DataFrame:
    """Tokens of the ranked results up to the first that covers each expected range, a line's slack aside; null if none does.

    results(instance, rank, file, start, end, tokens), expected(instance, file, start, end).
    """
    w = Window.partitionBy("instance").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = results.withColumn("sum_tokens", F.sum("tokens").over(w)).withColumnsRenamed({"start": "r_start", "end": "r_end"})
    x = expected.join(r, ["instance", "file"], "left")
    covers = (F.col("r_start") - slack <= F.col("start")) & (F.col("r_end") + slack >= F.col("end"))
    return x.groupBy("instance", "file", "start", "end").agg(F.min(F.when(covers, F.col("sum_tokens"))).alias("needed"))


def capped(hits: DataFrame, per_group: list[str], order: list[str], per: int, overall: list[str], total: int) -> DataFrame:
    """At most ``per`` rows per group and ``total`` rows per ``overall`` key, in order (F8)."""
    x = hits.withColumn("n_group", F.row_number().over(Window.partitionBy(*overall, *per_group).orderBy(*order))).where(F.col("n_group") <= per)
    return x.withColumn("n_all", F.row_number().over(Window.partitionBy(*overall).orderBy(*order))).where(F.col("n_all") <= total).drop("n_group")


def exact_only(hits: DataFrame, group: list[str], exact: str) -> DataFrame:
    """The exact hits of a group if it has any, else all (F8)."""
    return hits.withColumn("any_exact", F.max(F.col(exact).cast("int")).over(Window.partitionBy(*group))).where((F.col("any_exact") == 0) | F.col(exact)).drop("any_exact")


def snapped(lines: DataFrame, file: list[str], line: str = "line_no", text: str = "text", reach: int = 4) -> DataFrame:
    """Per line the nearest line with content within ``reach`` lines above and below."""
    filled = F.when(F.length(F.trim(text)) > 0, F.col(line))
    w = Window.partitionBy(*file).orderBy(line)
    return lines.withColumn("above", F.max(filled).over(w.rowsBetween(-reach, -1))).withColumn("below", F.min(filled).over(w.rowsBetween(1, reach)))


def linked(rows: DataFrame, group: list[str], order: list[str], key: str) -> DataFrame:
    """Each row with the key of the next."""
    return rows.withColumn("next", F.lead(key).over(Window.partitionBy(*group).orderBy(*order)))


def without_repeated_lines(new: Column, old: Column) -> Column:
    """Lines of ``new`` without its longest ending that is also the beginning of ``old``; both are arrays of lines."""
    most = F.least(F.size(new), F.size(old))
    fits = F.filter(F.sequence(F.lit(0), most), lambda k: (k == 0) | (F.slice(new, F.size(new) - k + 1, F.greatest(k, F.lit(1))) == F.slice(old, 1, F.greatest(k, F.lit(1)))))
    return F.slice(new, 1, F.size(new) - F.array_max(fits))


def carried(rows: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The last known value up to each row."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def running_distance(blocks: DataFrame, group: list[str], order: list[str], tokens: str = "tokens") -> DataFrame:
    """Tokens before and up to each block."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("upto", F.sum(tokens).over(w)).withColumn("before", F.col("upto") - F.col(tokens))
