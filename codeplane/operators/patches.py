"""Patches against spans, expected against actual hunks, related spans and edits of line ranges."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graphs import checkpointed


def patch_spans(hunks: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans whose lines a patch's hunks share, per patch and file.

    hunks(keys.., file, start, end), spans(file, span_id, s, e) and, where files of several repositories may be called
    alike, a repo_id in both, which is part of the key.
    """
    hit = hunks.join(spans, [c for c in ("repo_id", "file") if c in hunks.columns and c in spans.columns]).where((F.col("s") <= F.col("end")) & (F.col("e") >= F.col("start")))
    return hit.groupBy(*keys, "file").agg(F.sort_array(F.collect_set("span_id")).alias("spans"))


def compared(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Per key the expected files that were not touched and the pairs in which an actual hunk of the file misses an expected one.

    Hunks(key, file, start, end); a hunk is hit if an actual one holds it, and every pair that misses counts.
    """
    e, a = expected.select(key, "file", F.col("start").alias("s"), F.col("end").alias("t")), actual.select(key, "file", F.col("start").alias("a"), F.col("end").alias("b"))
    files = e.select(key, "file").distinct().join(a.select(key, "file").distinct().withColumn("hit", F.lit(1)), [key, "file"], "left").groupBy(key).agg(F.count_if(F.col("hit").isNull()).alias("file_misses"))
    pairs = e.join(a, [key, "file"]).groupBy(key).agg(F.count_if(~((F.col("a") <= F.col("s")) & (F.col("t") <= F.col("b")))).alias("hunk_misses"))
    return files.join(pairs, key, "left").fillna(0, ["hunk_misses"])


def related(edges: DataFrame, group: str) -> DataFrame:
    """(group, node, related): what a node points to or is pointed to by."""
    e = edges.select(group, F.col("src").alias("node"), F.col("dst").alias("related"))
    return e.unionAll(edges.select(group, F.col("dst").alias("node"), F.col("src").alias("related"))).where("node <> related").distinct()


def replaced_lines(text: Column, start: int, end: int, new: list[str]) -> Column:
    """The text with lines [start, end), counted from 0, replaced; blank lines at the edges of what is new are trimmed."""
    while new and not new[0].strip():
        new = new[1:]
    while new and not new[-1].strip():
        new = new[:-1]
    lines = F.split(text, "\n", -1)
    middle = F.array(*[F.lit(x) for x in new]) if new else F.array().cast("array<string>")
    tail = F.when(F.size(lines) > end, F.slice(lines, F.lit(end + 1), F.greatest(F.size(lines) - end, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.slice(lines, 1, start), middle, tail), "\n")


def report(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """A Markdown table per group, its rows in order of the columns."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    return rows.groupBy(group).agg(F.concat(F.lit(head + "\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*columns, line.alias("__l")))), lambda x: x["__l"]), "\n")).alias("report"))


def expanded(seeds: DataFrame, edges: DataFrame, tokens: DataFrame, limit: int, group: str, depth: int | None = None) -> DataFrame:
    """Nodes reached from seeds by breadth, level by level and then by name, while their tokens fit.

    seeds(group, node), edges(group, src, dst), tokens(group, node, tokens). Goes on until a group has no new nodes, or
    those found are over the limit, so that none behind them fits; with a depth, at most so many levels.
    """
    from pyspark.sql import Window

    near = checkpointed(related(edges, group))
    found = front = checkpointed(seeds.select(group, "node").distinct().withColumn("level", F.lit(0)))
    for level in count(1) if depth is None else range(1, depth + 1):
        spent = found.join(tokens, [group, "node"]).groupBy(group).agg(F.sum("tokens").alias("spent")).where(F.col("spent") > limit)
        front = front.join(spent, group, "left_anti")
        front = front.join(near, [group, "node"]).select(group, F.col("related").alias("node")).distinct().join(found.select(group, "node"), [group, "node"], "left_anti").withColumn("level", F.lit(level))
        front = checkpointed(front)
        if front.limit(1).count() == 0:
            break
        found = checkpointed(found.unionByName(front))
    w = Window.partitionBy(group).orderBy("level", "node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = found.join(tokens, [group, "node"]).withColumn("sum_tokens", F.sum("tokens").over(w))
    return x.where(F.col("sum_tokens") <= limit)
