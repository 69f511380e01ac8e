"""Structured code search over blocks, spans and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .ordered import exact_only, numbered


def name_index(blocks: DataFrame) -> DataFrame:
    """Identifier -> its places, for classes and functions (J8). blocks(repo_id, file_path, type, identifier, path)."""
    return blocks.where("type IN ('class', 'function')").groupBy("repo_id", "type", "identifier").agg(F.sort_array(F.collect_set(F.struct("file_path", "path"))).alias("places"))


def find_by_name(blocks: DataFrame, names: list[str], kind: str, pattern: str | None = None, tests: bool = False, within: str | None = None) -> DataFrame:
    """Blocks of a kind with one of the names, outside of tests unless wanted, under a path pattern if it leaves any.

    within: the name of a class that must hold the block.
    """
    found = blocks.where((F.col("type") == kind) & F.col("identifier").isin(names))
    if within is not None:
        found = found.where(F.array_contains(F.split("path", r"\."), within))
    if not tests:
        found = found.where(~X.matches_any(F.col("file_path"), X.TEST_GLOBS))
    if pattern is None:
        return found
    hits = found.withColumn("__in", F.col("file_path").rlike(X.glob_regex(pattern)))
    return exact_only(hits.withColumn("__all", F.lit(1)), ["__all"], "__in").drop("__in", "__all")


def find_by_names(blocks: DataFrame, names: DataFrame, kind: str, tests: bool = False) -> DataFrame:
    """As find_by_name, for a table names(repo_id, identifier) of any size."""
    found = blocks.where(F.col("type") == kind).join(names.select("repo_id", "identifier").distinct(), ["repo_id", "identifier"], "left_semi")
    return found if tests else found.where(~X.matches_any(F.col("file_path"), X.TEST_GLOBS))


def unique(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys.., value, is_error): what a lookup by key gives; a key of several rows is an error and has no value."""
    return rows.groupBy(*keys).agg(F.when(F.count("*") == 1, F.min(value)).alias(value), (F.count("*") > 1).alias("is_error"))


def post_filtered(hits: DataFrame, category: str | None = None, include: list[str] | None = None, exclude_tests: bool = False, content: str | None = None) -> DataFrame:
    """Filters that follow a top-k, so that fewer than k may remain."""
    if category is not None:
        hits = hits.where(F.col("category") == category)
    if include:
        hits = hits.where(X.matches_any(F.col("file_path"), include))
    if exclude_tests:
        hits = hits.where(~X.matches_any(F.col("file_path"), X.TEST_GLOBS))
    if content is not None:
        hits = hits.where(X.contains_unspaced(F.col("content"), F.lit(content)))
    return hits


def spans_of_hits(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """The spans that hits name, and for hits that name none of the file's the spans that overlap their lines.

    hits(hit, file_path, span_ids, start_line, end_line), spans(file_path, span_id, s, e).
    """
    named = hits.select("hit", "file_path", F.explode("span_ids").alias("span_id")).join(spans.select("file_path", "span_id"), ["file_path", "span_id"], "left_semi")
    rest = hits.join(named.select("hit").distinct(), "hit", "left_anti")
    near = rest.join(spans, "file_path").where(X.overlaps_lines(F.col("start_line"), F.col("end_line"), F.col("s"), F.col("e"))).select("hit", "file_path", "span_id")
    return named.select("hit", "file_path", "span_id").unionByName(near).distinct()


def spans_by_lines(blocks: DataFrame, ranges: DataFrame, files: list[str]) -> DataFrame:
    """Spans of the blocks that share lines with given ranges (N22). ranges(files.., s, e)."""
    b = blocks.select(*files, "span_id", "start_line", "end_line")
    return b.join(ranges, files).where(X.overlaps_lines(F.col("start_line"), F.col("end_line"), F.col("s"), F.col("e"))).select(*files, "s", "e", "span_id").distinct()


def partial_ratio(short: str, long: str) -> float:
    """The best similarity (indels, 0-100) of the shorter text with a window of the longer."""
    if len(short) > len(long):
        short, long = long, short
    n = len(short)
    if not n:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    best = 0.0
    for at in range(-n + 1, len(long)):
        window = long[max(0, at) : at + n]
        row = [0] * (n + 1)
        for c in window:
            before = 0
            for j, d in enumerate(short, 1):
                keep = row[j]
                row[j] = before + 1 if c == d else max(row[j], row[j - 1])
                before = keep
        best = max(best, 200.0 * row[n] / (n + len(window)))
    return best


def reranked(paths: DataFrame, pattern: str, path: str = "file_path") -> DataFrame:
    """Paths by their similarity to a pattern, best first."""

    def ratio(s):
        return s.map(lambda p: partial_ratio(pattern, p) if p is not None else None)

    ratio = F.pandas_udf(ratio, "double", F.PandasUDFType.SCALAR)
    return numbered(paths.withColumn("similarity", ratio(F.col(path))), [F.desc("similarity"), F.col(path)], "place")


def search_requests(hits: DataFrame, results: int) -> DataFrame:
    """Hits of several requests, each with its share of the results, not de-duplicated (G15). hits(request, place, ..)."""
    n = hits.select("request").distinct().agg(F.count("*").alias("__n"))
    return hits.join(F.broadcast(n)).withColumn("__r", F.row_number().over(Window.partitionBy("request").orderBy("place"))).where(F.col("__r") <= F.floor(F.lit(results) / F.col("__n"))).drop("__n", "__r")


def two_arm(code: DataFrame, clusters: DataFrame, n_code: int = 4, tokens: int = 25) -> DataFrame:
    """The first code hits and all cluster hits, as spans of equal size."""
    return code.orderBy("distance", "id").limit(n_code).unionByName(clusters).withColumn("tokens", F.lit(tokens))


def initial_context(hits: DataFrame, group: list[str], per_file: int = 5, results: int = 50) -> DataFrame:
    """Ranked hits with at most so many per file and in all (G13): only the best ``results`` meet in a task."""
    kept = hits.withColumn("__n", F.row_number().over(Window.partitionBy(*group, "file_path").orderBy("distance", "id"))).where(F.col("__n") <= per_file).drop("__n")
    if group:
        return kept.withColumn("n_all", F.row_number().over(Window.partitionBy(*group).orderBy("distance", "id"))).where(F.col("n_all") <= results)
    return kept.orderBy("distance", "id").limit(results).withColumn("n_all", F.row_number().over(Window.orderBy("distance", "id")))


def found_or(first: DataFrame, fallback: DataFrame) -> DataFrame:
    """The first result, or the fallback if it is empty."""
    some = first.limit(1).agg(F.count("*").alias("__n"))
    return first.unionByName(fallback.join(F.broadcast(some)).where("__n = 0").drop("__n"))


def in_any(column: Column, names: list[str]) -> Column:
    return column.isin(names)
