"""Ordered computations bound to the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ordered as O
from ..operators import metrics as M
from ..sources.chunks import clean_chunks
from .common import CC, TU
from .registry import query


def _cc(t):
    return clean_chunks(t("chunks"))


@query("f1_ordinals", f"WITH {CC} SELECT repo_id, file_path, ord, row_number() OVER (PARTITION BY repo_id, file_path ORDER BY ord) AS n FROM cc")
def f1(t):
    return O.ordinals(_cc(t), ["repo_id", "file_path"], ["ord"]).select("repo_id", "file_path", "ord", "n")


# Clusters of orders by customer; an order's index is its key, its place the date, its bytes the price.
_MEM = "m AS (SELECT o_custkey AS cluster_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos, o_orderkey AS idx FROM orders)"
_INP = "i AS (SELECT o_orderkey AS idx, CAST(floor(o_totalprice / 1000) AS BIGINT) AS bytes, coalesce(sum(CAST(floor(o_totalprice / 1000) AS BIGINT)) OVER (PARTITION BY o_orderkey // 1000 ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM orders)"


def _members(t):
    o = t("orders")
    return o.select(F.col("o_custkey").alias("cluster_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("pos"), F.col("o_orderkey").alias("idx"))


def _inputs(t):
    i = t("orders").select(F.col("o_orderkey").alias("idx"), F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("bytes"), F.floor(F.col("o_orderkey") / 1000).cast("bigint").alias("part"))
    return O.with_prefix_bytes(i, ["part"])


@query("f2_closeness_chunks", f"""WITH {_MEM}, g AS (SELECT cluster_id, abs(idx - lag(idx) OVER (PARTITION BY cluster_id ORDER BY pos)) AS gap FROM m)
 SELECT cluster_id, round(count(*) FILTER (WHERE gap <= 300) / greatest(count(*) - 1, 1), 8) AS closeness FROM g GROUP BY 1""")
def f2(t):
    return O.closeness_chunks(_members(t), 300).withColumn("closeness", F.round("closeness", 8))


@query("f3_closeness_bytes", f"""WITH {_MEM}, {_INP}, j AS (SELECT cluster_id, pos, idx, bytes, before FROM m JOIN i USING (idx)),
 a AS (SELECT *, max({{'i': idx, 'e': before}}) OVER (PARTITION BY cluster_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM j)
 SELECT cluster_id, round(count(*) FILTER (WHERE idx >= anchor.i AND before - anchor.e <= 1000) / count(*), 8) AS closeness FROM a GROUP BY 1""")
def f3(t):
    return O.closeness_bytes(_members(t).join(_inputs(t), "idx"), 1000).withColumn("closeness", F.round("closeness", 8))


@query("f4_byte_steps", f"""WITH {_MEM}, {_INP}, j AS (SELECT cluster_id, pos, before FROM m JOIN i USING (idx))
 SELECT cluster_id, pos, step FROM (SELECT cluster_id, pos, abs(before - lag(before) OVER (PARTITION BY cluster_id ORDER BY pos)) AS step FROM j) WHERE step IS NOT NULL""")
def f4(t):
    return O.byte_steps(_members(t).join(_inputs(t), "idx")).select("cluster_id", "pos", "step")


_SP = "s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rank, CAST(10 + floor(value * 10) AS INT) AS tokens FROM events)"


@query("f5_ranked_budget", f"""WITH {_SP}, a AS (SELECT *, sum(tokens) OVER (PARTITION BY user_id) AS total, sum(least(tokens, 50)) OVER (PARTITION BY user_id ORDER BY rank) AS used FROM s),
 k AS (SELECT * FROM a WHERE total < 2000 OR used <= 2000), w AS (SELECT *, pow(1.05, -rank) / sum(pow(1.05, -rank)) OVER (PARTITION BY user_id) AS w, 2000 - sum(least(tokens, 50)) OVER (PARTITION BY user_id) AS lft FROM k)
 SELECT user_id, rank, tokens, CASE WHEN total < 2000 THEN tokens ELSE least(tokens, 50 + CAST(floor(lft * w) AS INT)) END AS given FROM w""")
def f5(t):
    e = t("events")
    s = e.select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("rank"), (10 + F.floor(F.col("value") * 10)).cast("int").alias("tokens"))
    return O.ranked_budget(s, ["user_id"], 2000)


@query("f6_context_needed", f"""WITH {CC}, r AS (SELECT repo_id AS instance, file_path AS file, start_line AS s, end_line AS e, sum(greatest(coalesce(tokens, 0), 0)) OVER (PARTITION BY repo_id ORDER BY file_path, ord) AS st FROM cc),
 x AS (SELECT repo_id AS instance, file_path AS file, start_line + 2 AS s, start_line + 4 AS e FROM cc WHERE ord = 1)
 SELECT x.instance, x.file, x.s AS start, x.e AS end_, min(st) FILTER (WHERE r.s - 1 <= x.s AND r.e + 1 >= x.e) AS needed FROM x LEFT JOIN r USING (instance, file) GROUP BY 1, 2, 3, 4""")
def f6(t):
    c = _cc(t)
    r = c.select(F.col("repo_id").alias("instance"), F.row_number().over(Window.partitionBy("repo_id").orderBy("file_path", "ord")).alias("rank"), F.col("file_path").alias("file"), F.col("start_line").alias("start"), F.col("end_line").alias("end"), F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).alias("tokens"))
    x = c.where("ord = 1").select(F.col("repo_id").alias("instance"), F.col("file_path").alias("file"), (F.col("start_line") + 2).alias("start"), (F.col("start_line") + 4).alias("end"))
    return O.context_needed(r, x).withColumnRenamed("end", "end_")


@query("f7_ranks", f"WITH {CC} SELECT repo_id, file_path, ord, row_number() OVER (PARTITION BY repo_id ORDER BY file_path, ord) - 1 AS place, dense_rank() OVER (PARTITION BY repo_id ORDER BY file_path) - 1 AS file_rank FROM cc")
def f7(t):
    w = Window.partitionBy("repo_id")
    return _cc(t).select("repo_id", "file_path", "ord", (F.row_number().over(w.orderBy("file_path", "ord")) - 1).alias("place"), (F.dense_rank().over(w.orderBy("file_path")) - 1).alias("file_rank"))


@query("f8_capped", f"""WITH {CC}, a AS (SELECT repo_id, file_path, ord, row_number() OVER (PARTITION BY repo_id, file_path ORDER BY ord) AS g FROM cc), b AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ord, file_path) AS n_all FROM a WHERE g <= 2)
 SELECT repo_id, file_path, ord, n_all FROM b WHERE n_all <= 10""")
def f8(t):
    return O.capped(_cc(t).select("repo_id", "file_path", "ord"), ["file_path"], ["ord", "file_path"], 2, ["repo_id"], 10).select("repo_id", "file_path", "ord", "n_all")


@query("f8_exact_only", "WITH e AS (SELECT user_id, event_id, event_type = 'purchase' AS exact FROM events) SELECT user_id, event_id FROM (SELECT *, max(CAST(exact AS INT)) OVER (PARTITION BY user_id) AS a FROM e) WHERE a = 0 OR exact")
def f8b(t):
    return O.exact_only(t("events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("exact")), ["user_id"], "exact").select("user_id", "event_id")


@query("f9_token_distance", f"WITH {CC} SELECT repo_id, file_path, ord, sum(coalesce(tokens, 0)) OVER (PARTITION BY repo_id, file_path ORDER BY ord) AS upto FROM cc")
def f9(t):
    c = _cc(t).withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    return O.running_distance(c, ["repo_id", "file_path"], ["ord"]).select("repo_id", "file_path", "ord", "upto")


@query("f10_span_neighbours", f"""WITH {CC} SELECT repo_id, file_path, ord, lag(ord) OVER w AS before, first_value(start_line) OVER w AS first_start, last_value(end_line) OVER (PARTITION BY repo_id, file_path ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_end FROM cc WINDOW w AS (PARTITION BY repo_id, file_path ORDER BY ord)""")
def f10(t):
    w = Window.partitionBy("repo_id", "file_path").orderBy("ord")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return _cc(t).select("repo_id", "file_path", "ord", F.lag("ord").over(w).alias("before"), F.first("start_line").over(w).alias("first_start"), F.last("end_line").over(full).alias("last_end"))


_LN = f"{CC}, l AS (SELECT repo_id, file_path, ord, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no, unnest(string_split(content, chr(10))) AS text FROM cc)"


def _lines(t):
    c = _cc(t).where("content IS NOT NULL")
    return c.select("repo_id", "file_path", "ord", F.posexplode(F.split("content", "\n")).alias("p", "text")).select("repo_id", "file_path", "ord", (F.col("p") + 1).alias("line_no"), "text")


@query("f11_snapped", f"""WITH {_LN}, f AS (SELECT *, CASE WHEN length(trim(text)) > 0 THEN line_no END AS k FROM l)
 SELECT repo_id, file_path, ord, line_no, max(k) OVER (PARTITION BY repo_id, file_path, ord ORDER BY line_no ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS above, min(k) OVER (PARTITION BY repo_id, file_path, ord ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS below FROM f""")
def f11(t):
    return O.snapped(_lines(t), ["repo_id", "file_path", "ord"]).select("repo_id", "file_path", "ord", "line_no", "above", "below")


@query("f12_edit_span", f"""WITH {CC} SELECT repo_id, file_path, ord, CASE WHEN end_line - start_line <= 20 THEN start_line ELSE greatest(start_line, (start_line + end_line) // 2 - 4) END AS s,
 CASE WHEN end_line - start_line <= 20 THEN end_line ELSE least(end_line, (start_line + end_line) // 2 + 4) END AS e FROM cc""")
def f12(t):
    small = F.col("end_line") - F.col("start_line") <= 20
    middle = F.floor((F.col("start_line") + F.col("end_line")) / 2)
    return _cc(t).select("repo_id", "file_path", "ord", F.when(small, F.col("start_line")).otherwise(F.greatest(F.col("start_line"), middle - 4)).alias("s"), F.when(small, F.col("end_line")).otherwise(F.least(F.col("end_line"), middle + 4)).alias("e"))


@query("f13_next_item", f"WITH {CC} SELECT repo_id, file_path, ord, lead(chunk_id) OVER (PARTITION BY repo_id, file_path ORDER BY ord) AS next FROM cc")
def f13(t):
    return O.linked(_cc(t), ["repo_id", "file_path"], ["ord"], "chunk_id").select("repo_id", "file_path", "ord", "next")


@query("f14_line_overlap", f"""WITH {CC}, x AS (SELECT repo_id, file_path, ord, string_split(content, chr(10)) AS a, string_split(lead(content) OVER (PARTITION BY repo_id, file_path ORDER BY ord), chr(10)) AS b FROM cc WHERE content IS NOT NULL)
 SELECT repo_id, file_path, ord, len(a) - list_max(list_filter(range(0, least(len(a), len(b)) + 1), lambda k: k = 0 OR a[len(a) - k + 1 : len(a)] = b[1 : k])) AS n_kept FROM x WHERE b IS NOT NULL""")
def f14(t):
    w = Window.partitionBy("repo_id", "file_path").orderBy("ord")
    x = _cc(t).where("content IS NOT NULL").select("repo_id", "file_path", "ord", F.split("content", "\n").alias("a"), F.split(F.lead("content").over(w), "\n").alias("b")).where("b IS NOT NULL")
    return x.select("repo_id", "file_path", "ord", F.size(O.without_repeated_lines(F.col("a"), F.col("b"))).alias("n_kept"))


@query("f15_carried", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events")
def f15(t):
    e = t("events").withColumn("p", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return O.carried(e, ["user_id"], ["event_id"], "p", "last_purchase").select("event_id", "last_purchase")


@query("d17_event_log", f"WITH {TU} SELECT session_id, count(*) AS n, min(created_at) AS first_at, max(created_at) AS last_at FROM tu GROUP BY 1")
def d17(t):
    return M.latest_calls(t("token_usage")).groupBy("session_id").agg(F.count("*").alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
