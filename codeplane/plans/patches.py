"""Patches, related chunks, edits and reports bound to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import extract as B
from ..operators import patches as P
from ..sources.chunks import clean_chunks, files
from .common import CC
from .registry import query


def _cc(t):
    return clean_chunks(t("chunks"))


@query("n24_patch_spans")
def n24(t):
    h = B.hunks(files(t("chunks")).where("content LIKE '%@@ -%'"), ["repo_id", "file_path"])
    s = _cc(t).select("repo_id", F.col("file_path").alias("file"), F.explode("span_ids").alias("span_id"), F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    return P.patch_spans(h, s, ["repo_id", "file_path"])


_H = "ex AS (SELECT o_custkey AS k, o_orderkey % 5 AS file, CAST(floor(o_totalprice / 5000) AS INT) AS start, CAST(floor(o_totalprice / 5000) AS INT) + 3 AS end_ FROM orders WHERE o_orderkey % 2 = 0), ac AS (SELECT o_custkey AS k, o_orderkey % 5 AS file, CAST(floor(o_totalprice / 7000) AS INT) AS start, CAST(floor(o_totalprice / 7000) AS INT) + 20 AS end_ FROM orders WHERE o_orderkey % 2 = 1)"


@query("n27_compared_patches", f"""WITH {_H}, f AS (SELECT k, count(*) FILTER (WHERE hit IS NULL) AS file_misses FROM (SELECT DISTINCT k, file FROM ex) LEFT JOIN (SELECT DISTINCT k, file, 1 AS hit FROM ac) USING (k, file) GROUP BY 1),
 p AS (SELECT k, count(*) FILTER (WHERE NOT (ac.start <= ex.start AND ex.end_ <= ac.end_)) AS hunk_misses FROM ex JOIN ac USING (k, file) GROUP BY 1) SELECT k, file_misses, coalesce(hunk_misses, 0) AS hunk_misses FROM f LEFT JOIN p USING (k)""")
def n27(t):
    o = t("orders")
    h = lambda r, d, n: o.where(f"o_orderkey % 2 = {r}").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 5).alias("file"), F.floor(F.col("o_totalprice") / d).cast("int").alias("start"), (F.floor(F.col("o_totalprice") / d).cast("int") + n).alias("end"))
    return P.compared(h(0, 5000, 3), h(1, 7000, 20), "k")


_ED = f"{CC}, ed AS (SELECT repo_id, chunk_id AS src, unnest(map_keys(imports)) AS dst FROM cc)"


@query("n23_related_chunks", f"WITH {_ED} SELECT repo_id, src AS node, dst AS related FROM ed WHERE src <> dst UNION SELECT repo_id, dst, src FROM ed WHERE src <> dst")
def n23(t):
    e = _cc(t).select("repo_id", F.col("chunk_id").alias("src"), F.explode(F.map_keys("imports")).alias("dst"))
    return P.related(e, "repo_id")


@query("h17_expanded_context")
def h17(t):
    c = _cc(t)
    e = c.select("repo_id", F.col("chunk_id").alias("src"), F.explode(F.map_keys("imports")).alias("dst"))
    tokens = c.groupBy("repo_id", F.col("chunk_id").alias("node")).agg(F.sum(F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0))).alias("tokens"))
    seeds = c.groupBy("repo_id").agg(F.min("chunk_id").alias("node"))
    return P.expanded(seeds, e, tokens, 4000, "repo_id").select("repo_id", "node", "level", "sum_tokens")


@query("b21_lint_codes", "SELECT event_id, event_type FROM events WHERE upper(event_type[1]) IN ('E', 'P')")
def b21(t):
    return t("events").where(F.upper(F.substring("event_type", 1, 1)).isin("E", "P")).select("event_id", "event_type")


@query("b26_tag_texts", f"WITH {CC} SELECT repo_id, file_path, ord, len(regexp_extract_all(content, '(?s)<title>(.*?)</title>', 1)) AS n FROM cc WHERE content LIKE '%<title>%'")
def b26(t):
    return _cc(t).where("content LIKE '%<title>%'").select("repo_id", "file_path", "ord", F.size(X.between_tags(F.col("content"), "title")).alias("n"))


@query("i14_replaced_lines", f"WITH {CC}, s AS (SELECT repo_id, file_path, ord, string_split(content, chr(10)) AS l FROM cc WHERE content IS NOT NULL) SELECT repo_id, file_path, ord, array_to_string(list_concat(list_concat(l[1:1], ['new']), l[4:len(l)]), chr(10)) AS content FROM s")
def i14(t):
    return _cc(t).where("content IS NOT NULL").select("repo_id", "file_path", "ord", P.replaced_lines(F.col("content"), 1, 3, ["", "new", " "]).alias("content"))


@query("j10_report", "SELECT n_regionkey, '| n_nationkey | n_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS report FROM nation GROUP BY 1")
def j10(t):
    return P.report(t("nation"), "n_regionkey", ["n_nationkey", "n_name"])


@query("c20_error_blocks")
def c20(t):
    return B.blocks(files(t("chunks"), ("py",))).where("type = 'ERROR' OR duplicate = 1").select("repo_id", "file_path", "type", "path")


@query("n40_in_class")
def n40(t):
    b = B.blocks(files(t("chunks"), ("py",)))
    return b.where("type = 'function' AND path LIKE '%.%'").select("repo_id", "file_path", "path", F.element_at(F.split("path", r"\."), -2).alias("holder"))
