"""Sources, settings and event windows bound to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources import io
from ..sources.chunks import clean_chunks, files
from ..streaming import windows as W
from .common import CC
from .registry import query


@query("a2_file_contents", f"WITH {CC} SELECT repo_id, file_path, string_agg(coalesce(content, ''), chr(10) ORDER BY ord) AS content FROM cc WHERE file_path LIKE '%.py' GROUP BY 1, 2 HAVING NOT starts_with(list_extract(string_split(file_path, '/'), -1), 'test_')")
def a2(t):
    return files(t("chunks"), ("py",)).where(~X.basename(F.col("file_path")).startswith("test_"))


@query("a5_line_range", f"WITH {CC} SELECT repo_id, file_path, ord, array_to_string(list_slice(string_split(content, chr(10)), 3, 6), chr(10)) AS part FROM cc WHERE content IS NOT NULL")
def a5(t):
    return clean_chunks(t("chunks")).where("content IS NOT NULL").select("repo_id", "file_path", "ord", X.lines(F.col("content"), 2, 6).alias("part"))


@query("a20_sorted_source", "SELECT id, owner, views FROM repos")
def a20(t):
    return t("repos").select("id", "owner", "views").orderBy("id")


@query("a22_added_column", "SELECT r_regionkey, r_name, 0.5::DOUBLE AS weight FROM region")
def a22(t):
    return io.with_column(t("region"), "weight", "REAL", "0.5")


@query("a23_catalog")
def a23(t):
    return io.describe(t("chunks"), "chunks").unionAll(io.describe(t("repos"), "repos"))


@query("a25_next_index", f"WITH {CC} SELECT coalesce(max(CAST(nullif(regexp_extract(file_name, '_(\\d+)\\.\\w+$', 1), '') AS INT)), 0) + 1 AS next_index FROM cc")
def a25(t):
    return io.next_report_index(clean_chunks(t("chunks")), "file_name")


@query("a29_merged_settings", "SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v FROM (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey < 20) a FULL JOIN (SELECT n_nationkey AS k, lower(n_name) AS v FROM nation WHERE n_nationkey > 15) b ON a.k = b.k")
def a29(t):
    n = t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    return io.merged_settings(n.where("k < 20"), n.where("k > 15").withColumn("v", F.lower("v")), "k", "v")


@query("a30_scraped_names", "SELECT doc_id, unnest(regexp_extract_all(text, '`([a-z_]+)\\(\\)`', 1)) AS name FROM documents")
def a30(t):
    return t("documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"`([a-z_]+)\(\)`"), 1)).alias("name"))


@query("a31_pending", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def a31(t):
    o = t("orders")
    return io.pending(o.select("o_orderkey"), o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "done").alias("status"), F.lit(None).cast("string").alias("error")), "o_orderkey")


@query("a9_node_link")
def a9(t):
    return io.to_node_link(t("region").select(F.col("r_regionkey").alias("id"), "r_name"), t("nation").select(F.col("n_regionkey").alias("source"), F.col("n_nationkey").alias("target")))


@query("s1_event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def s1(t):
    return W.windowed(t("events"), "1 hour").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("s2_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
 SELECT user_id, min(ts) AS first_at, count(*) AS n FROM s GROUP BY user_id, session""")
def s2(t):
    return W.sessions(t("events"), "30 minutes").select("user_id", F.col("first_at").cast("timestamp_ntz").alias("first_at"), "n")
