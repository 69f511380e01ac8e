"""Scores and roll-ups bound to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import metrics as M
from ..sources.chunks import clean_chunks
from .common import CC, EXT, TU
from .registry import query

def _ext():
    return F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1))


def _cc(t):
    return clean_chunks(t("chunks"))


@query("e1_cluster_stats", f"WITH {CC}, s AS (SELECT repo_id, count(*) AS n FROM cc GROUP BY 1) SELECT count(*) AS n_clusters, sum(n) AS n_chunks, avg(n) AS mean_size FROM s")
def e1(t):
    return M.cluster_stats(_cc(t), "repo_id")


@query("e2_subtree_tokens", f"""WITH {CC}, p AS (SELECT repo_id, string_split(file_path, '/') AS parts, greatest(coalesce(tokens, 0), 0) AS v FROM cc),
 x AS (SELECT repo_id, array_to_string(parts[1:n], '/') AS prefix, v FROM (SELECT repo_id, parts, v, unnest(range(1, len(parts) + 1)) AS n FROM p))
 SELECT repo_id, prefix, sum(v) AS total FROM x GROUP BY 1, 2""")
def e2(t):
    return M.subtree_sums(_cc(t).withColumn("v", F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0))), "repo_id", "file_path", "v")


@query("e3_file_tokens", f"WITH {CC} SELECT repo_id, file_path, sum(tokens) AS tokens, count(*) AS n_chunks FROM cc GROUP BY 1, 2")
def e3(t):
    return _cc(t).groupBy("repo_id", "file_path").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_chunks"))


@query("e4_context_size", f"WITH {CC} SELECT repo_id, sum(tokens) FILTER (WHERE tokens > 0) AS context_size FROM cc WHERE category = 'implementation' GROUP BY 1")
def e4(t):
    return _cc(t).where("category = 'implementation'").groupBy("repo_id").agg(F.sum(F.when(F.col("tokens") > 0, F.col("tokens"))).alias("context_size"))


@query("e5_tokens_grouping_sets", f"WITH {CC} SELECT repo_id, sum(tokens) AS total, CAST(grouping(repo_id) AS INT) AS is_total FROM cc GROUP BY GROUPING SETS ((repo_id), ())")
def e5(t):
    return M.group_and_total(_cc(t), "repo_id", "tokens")


_GOLD = "gold AS (SELECT id, list_distinct(flatten(list(cluster_files))) AS gold FROM repos WHERE cluster_files IS NOT NULL GROUP BY id)"


@query("e6_recall", f"""WITH {CC}, {_GOLD}, got AS (SELECT repo_id, list(DISTINCT array_to_string(list_slice(string_split(file_path, '/'), -2, -1), '/')) AS got FROM cc GROUP BY 1)
 SELECT id, len(list_intersect(gold, coalesce(got, []))) / len(gold) AS recall FROM gold LEFT JOIN got ON id = repo_id WHERE len(gold) > 0""")
def e6(t):
    gold = t("repos").where("cluster_files IS NOT NULL").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("cluster_files"))).alias("gold")).where(F.size("gold") > 0)
    parts = F.split("file_path", "/")
    tail = F.array_join(F.when(F.size(parts) > 1, F.slice(parts, -2, 2)).otherwise(parts), "/")
    got = _cc(t).groupBy("repo_id").agg(F.collect_set(tail).alias("got"))
    return gold.join(got, F.col("id") == F.col("repo_id"), "left").select("id", M.recall(F.col("gold"), F.coalesce("got", F.array().cast("array<string>"))).alias("recall"))


@query("e7_cross_file", f"WITH {CC} SELECT repo_id, count(*) AS n, pow(count(DISTINCT file_path), 1.3) / count(*) AS score FROM cc GROUP BY 1")
def e7(t):
    return M.cross_file(_cc(t), "repo_id", "file_path")


@query("e8_mean_cross_file", f"WITH {CC}, s AS (SELECT repo_id, count(*) AS n, pow(count(DISTINCT file_path), 1.3) / count(*) AS score FROM cc GROUP BY 1) SELECT coalesce(avg(score), 0) AS mean_score FROM s WHERE n >= 3")
def e8(t):
    return M.mean_cross_file(M.cross_file(_cc(t), "repo_id", "file_path"))


@query("e9_rating_summary", f"""WITH {TU}, r AS (SELECT model, function_name, latency_ms FROM tu WHERE model IS NOT NULL AND latency_ms >= 0), p AS (SELECT model, avg(latency_ms) AS mean_rating FROM r GROUP BY 1),
 i AS (SELECT avg(m) AS grand_mean, stddev_pop(m) AS deviation FROM (SELECT avg(latency_ms) AS m FROM r GROUP BY function_name))
 SELECT model, round(mean_rating, 4) AS mean_rating, round(grand_mean, 4) AS grand_mean, round(deviation, 4) AS deviation, rank() OVER (ORDER BY mean_rating DESC) AS position FROM p, i""")
def e9(t):
    r = M.latest_calls(t("token_usage")).where("model IS NOT NULL AND latency_ms >= 0")
    out = M.rating_summary(r, "model", "function_name", "latency_ms")
    return out.select("model", *[F.round(c, 4).alias(c) for c in ("mean_rating", "grand_mean", "deviation")], "position")


@query("e10_exponent_sweep", f"""WITH {CC}, s AS (SELECT repo_id, count(*) AS n, count(DISTINCT file_path) AS f FROM cc GROUP BY 1)
 SELECT repo_id, exponent, round(pow(f, exponent) / n, 6) AS score FROM s, (VALUES (1.0::DOUBLE), (1.15), (1.3), (1.5)) e(exponent)""")
def e10(t):
    return M.exponent_sweep(_cc(t), "repo_id", "file_path", [1.0, 1.15, 1.3, 1.5]).withColumn("score", F.round("score", 6))


@query("e10_blended", f"""WITH {CC} SELECT repo_id, round(1.5 * (avg(tokens) FILTER (WHERE tokens > 0) / 100) + pow(count(DISTINCT file_path), 1.3) / count(*), 6) AS blended FROM cc GROUP BY 1""")
def e10b(t):
    c = _cc(t).groupBy("repo_id").agg((F.avg(F.when(F.col("tokens") > 0, F.col("tokens"))) / 100).alias("coherence"), (F.pow(F.count_distinct("file_path").cast("double"), F.lit(1.3)) / F.count("*")).alias("cross"))
    return M.blended(c, "coherence", "cross").select("repo_id", F.round("blended", 6).alias("blended"))


@query("e11_pair_differences", f"""WITH {TU}, v AS (SELECT function_name AS m, avg(completion_tokens) AS x FROM tu WHERE function_name IS NOT NULL GROUP BY 1)
 SELECT a.m AS a, b.m AS b, round(a.x - b.x, 6) AS difference FROM v a JOIN v b ON a.m < b.m""")
def e11(t):
    v = M.latest_calls(t("token_usage")).where("function_name IS NOT NULL").groupBy("function_name").agg(F.avg("completion_tokens").alias("x"))
    return M.pair_differences(v, "function_name", "x").withColumn("difference", F.round("difference", 6))


@query("e12_perplexity", f"WITH {TU} SELECT session_id, round(exp(-avg(-completion_tokens / 1000.0)), 6) AS perplexity FROM tu WHERE completion_tokens IS NOT NULL GROUP BY 1")
def e12(t):
    lp = M.latest_calls(t("token_usage")).where("completion_tokens IS NOT NULL").select("session_id", (-F.col("completion_tokens") / 1000.0).alias("lp"))
    return M.perplexity(lp, "session_id", "lp").withColumn("perplexity", F.round("perplexity", 6))


_COST = f"""{TU}, pr AS (SELECT model, max(prompt) AS p, max(cached) AS c, max(completion) AS q FROM prices GROUP BY 1),
 k AS (SELECT tu.*, coalesce(prompt_tokens, 0) AS pt, coalesce(completion_tokens, 0) AS ct, least(coalesce(cached_tokens, 0), coalesce(prompt_tokens, 0)) AS ca, p, c, q FROM tu LEFT JOIN pr USING (model)),
 cost AS (SELECT *, (pt - ca) * p + ca * c + ct * q AS cost, ca * (p - c) AS saved FROM k)"""
_BY = """count(*) AS n_calls, sum(prompt_tokens) AS prompt_tokens, sum(completion_tokens) AS completion_tokens, round(sum(cost), 6) AS cost, round(sum(saved), 6) AS saved,
 round(100 * sum(saved) / (sum(cost) + sum(saved)), 4) AS saved_percent, round(sum(latency_ms) FILTER (WHERE latency_ms >= 0), 3) AS latency_ms FROM cost GROUP BY 1"""


def _costs(t, *by):
    out = M.cost_by(M.call_costs(M.latest_calls(t("token_usage")), t("prices")), *by)
    return out.select(*by, "n_calls", "prompt_tokens", "completion_tokens", F.round("cost", 6).alias("cost"), F.round("saved", 6).alias("saved"), F.round("saved_percent", 4).alias("saved_percent"), F.round("latency_ms", 3).alias("latency_ms"))


@query("e13_cost_by_model", f"WITH {_COST} SELECT model, {_BY}")
def e13(t):
    return _costs(t, "model")


@query("e14_session_cost", f"WITH {_COST} SELECT session_id, {_BY}")
def e14(t):
    return _costs(t, "session_id")


@query("e15_function_stats", f"WITH {_COST} SELECT function_name, {_BY}")
def e15(t):
    return _costs(t, "function_name")


_EV = ["click", "error", "purchase", "signup", "view"]


@query("e16_run_cost", "SELECT user_id, round(sum(coalesce(value, 0)), 4) AS total_cost FROM events GROUP BY 1")
def e16(t):
    return t("events").groupBy("user_id").agg(F.round(F.sum(F.coalesce("value", F.lit(0.0))), 4).alias("total_cost"))


_ROLL = "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{n}') AS {n}_count, round(coalesce(sum(value) FILTER (WHERE event_type = '{n}'), 0), 4) AS {n}_cost" for n in _EV) + ", count(*) AS n_transitions, round(sum(coalesce(value, 0)), 4) AS total_cost FROM events GROUP BY 1"


def _roll(t):
    r = M.transition_rollup(t("events"), "user_id", "event_type", "value", _EV)
    return r.select("user_id", *[f"{n}_count" for n in _EV], *[F.round(f"{n}_cost", 4).alias(f"{n}_cost") for n in _EV], "n_transitions", F.round("total_cost", 4).alias("total_cost"))


@query("e17_transition_rollup", f"SELECT *, CASE WHEN error_count > 3 THEN 'error' WHEN purchase_count > 0 THEN 'finished' WHEN click_count > 0 THEN 'active' ELSE 'idle' END AS status FROM ({_ROLL})")
def e17(t):
    s = F.when(F.col("error_count") > 3, "error").when(F.col("purchase_count") > 0, "finished").when(F.col("click_count") > 0, "active").otherwise("idle")
    return _roll(t).withColumn("status", s)


@query("e18_run_summary", f"""WITH r AS ({_ROLL}) SELECT count(*) AS n_runs, round(avg(total_cost), 4) AS mean_cost, round(avg(n_transitions), 4) AS mean_steps, count(*) FILTER (WHERE purchase_count > 0) AS n_finished,
 count(*) FILTER (WHERE error_count > 0) AS n_errors, round(count(*) FILTER (WHERE purchase_count > 0) / count(*), 6) AS success_rate FROM r""")
def e18(t):
    return _roll(t).agg(
        F.count("*").alias("n_runs"), F.round(F.avg("total_cost"), 4).alias("mean_cost"), F.round(F.avg("n_transitions"), 4).alias("mean_steps"), F.count_if(F.col("purchase_count") > 0).alias("n_finished"),
        F.count_if(F.col("error_count") > 0).alias("n_errors"), F.round(F.count_if(F.col("purchase_count") > 0) / F.count("*"), 6).alias("success_rate"),
    )


@query("e19_first_found", """WITH f AS (SELECT user_id, event_type, min(event_id) AS found FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1, 2), g AS (SELECT user_id, count(*) AS n, max(found) AS found FROM f GROUP BY 1)
 SELECT u.user_id, CASE WHEN n = 3 THEN found END AS found_at FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN g USING (user_id)""")
def e19(t):
    return M.first_iteration_found(t("events"), "user_id", "event_id", "event_type", ["view", "click", "purchase"])


@query("e20_dominant_language", f"""WITH {CC}, s AS (SELECT repo_id, {EXT} AS language, sum(length(content)) AS s FROM cc GROUP BY 1, 2)
 SELECT repo_id, language, s AS total_size FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY s DESC, language) AS rn FROM s) WHERE rn = 1""")
def e20(t):
    return M.dominant(_cc(t).select("repo_id", _ext().alias("language"), F.length("content").alias("n")), "repo_id", "language", "n")


@query("e21_differing_alternatives", f"""WITH {CC}, a AS (SELECT repo_id, file_path, list(DISTINCT s) AS spans FROM (SELECT repo_id, file_path, unnest(span_ids) AS s FROM cc WHERE category = 'implementation') GROUP BY 1, 2),
 e AS (SELECT repo_id, file_path, spans FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY file_path) AS rn FROM a) WHERE rn = 1)
 SELECT a.repo_id, a.file_path, len(list_filter(a.spans, lambda x: NOT list_contains(e.spans, x))) AS n_new FROM a JOIN e USING (repo_id) WHERE a.file_path <> e.file_path AND len(list_filter(a.spans, lambda x: NOT list_contains(e.spans, x))) > 0""")
def e21(t):
    a = _cc(t).where("category = 'implementation'").select("repo_id", "file_path", F.explode("span_ids").alias("s")).groupBy("repo_id", "file_path").agg(F.collect_set("s").alias("spans"))
    e = a.groupBy("repo_id").agg(F.min_by(F.struct(F.col("file_path").alias("f"), F.col("spans").alias("gold")), "file_path").alias("e")).select("repo_id", "e.*")
    new = F.size(F.array_except("spans", "gold"))
    return a.join(e, "repo_id").where((F.col("file_path") != F.col("f")) & (new > 0)).select("repo_id", "file_path", new.alias("n_new"))


@query("e22_load_summary", """SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean_value, round(count(*) / ((SELECT epoch(max(ts)) - epoch(min(ts)) FROM events)), 6) AS per_second FROM events GROUP BY 1""")
def e22(t):
    e = t("events")
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    span = e.agg((F.max(ts) - F.min(ts)).alias("span"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value")).join(F.broadcast(span)).select("event_type", "n", "mean_value", F.round(F.col("n") / F.col("span"), 6).alias("per_second"))


@query("e23_agreement", """WITH t AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2), r AS (SELECT a, sum(n) AS n FROM t GROUP BY 1), c AS (SELECT b, sum(n) AS n FROM t GROUP BY 1),
 z AS (SELECT sum(n) AS N_, sum(n * (n - 1) / 2) AS st FROM t), x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM r) AS sa, (SELECT sum(n * (n - 1) / 2) FROM c) AS sb,
 (SELECT sum(-n / N_ * ln(n / N_)) FROM r, z) AS ha, (SELECT sum(-n / N_ * ln(n / N_)) FROM c, z) AS hb, (SELECT sum(t.n / N_ * ln(t.n * N_ / (r.n * c.n))) FROM t JOIN r USING (a) JOIN c USING (b), z) AS mi)
 SELECT round((st - sa * sb / (N_ * (N_ - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (N_ * (N_ - 1) / 2)), 8) AS ari, round(2 * mi / (ha + hb), 8) AS nmi, round(2 * mi / (ha + hb), 8) AS v_measure FROM x, z""")
def e23(t):
    return M.agreement(t("orders"), "o_orderpriority", "o_orderstatus").select(*[F.round(c, 8).alias(c) for c in ("ari", "nmi", "v_measure")])


@query("e24_histogram", "SELECT CAST(greatest(0, least(499, floor(l_extendedprice / 200.0))) AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def e24(t):
    return M.histogram(t("lineitem"), "l_extendedprice", 0.0, 100_000.0, 500)


@query("e24_mean_median", "SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean_price, round(quantile_cont(l_extendedprice, 0.5), 4) AS median_price FROM lineitem GROUP BY 1")
def e24b(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_extendedprice"), 4).alias("mean_price"), F.round(F.percentile("l_extendedprice", 0.5), 4).alias("median_price"))


@query("e25_chunk_files", f"WITH {CC} SELECT repo_id, ord, file_path FROM cc")
def e25(t):
    return _cc(t).select("repo_id", "ord", "file_path")


@query("e26_duplicate_searches", f"WITH {TU} SELECT call_id, count(*) OVER (PARTITION BY repo_id, chunk_id, function_name, model) > 1 AS is_duplicate FROM tu WHERE chunk_id IS NOT NULL")
def e26(t):
    from pyspark.sql import Window

    w = Window.partitionBy("repo_id", "chunk_id", "function_name", "model")
    return M.latest_calls(t("token_usage")).where("chunk_id IS NOT NULL").select("call_id", (F.count("*").over(w) > 1).alias("is_duplicate"))


@query("e27_compression", f"WITH {CC} SELECT repo_id, round(sum(length(summary.long_description)) / sum(length(content)), 8) AS ratio FROM cc WHERE summary.long_description IS NOT NULL GROUP BY 1 HAVING sum(length(content)) > 0")
def e27(t):
    c = _cc(t).where("summary.long_description IS NOT NULL").groupBy("repo_id").agg(F.sum(F.length("summary.long_description")).alias("s"), F.sum(F.length("content")).alias("c"))
    return c.where("c > 0").select("repo_id", F.round(F.col("s") / F.col("c"), 8).alias("ratio"))


@query("e28_calls_by_day", f"WITH {TU} SELECT strftime(created_at, '%Y-%m-%d') AS day, function_name, count(*) AS n, CAST(sum(round(latency_ms * 1000)) FILTER (WHERE latency_ms >= 0) AS BIGINT) AS latency_us FROM tu GROUP BY 1, 2")
def e28(t):
    return M.latest_calls(t("token_usage")).groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day"), "function_name").agg(F.count("*").alias("n"), F.sum(F.when(F.col("latency_ms") >= 0, F.round(F.col("latency_ms") * 1000).cast("bigint"))).alias("latency_us"))


@query("e29_keep_at_most", "SELECT user_id, greatest(0, least(count(*) - 5, 20)) AS n_delete FROM events GROUP BY 1")
def e29(t):
    return t("events").groupBy("user_id").agg(F.greatest(F.lit(0), F.least(F.count("*") - 5, F.lit(20))).alias("n_delete"))


_SETS = "a AS (SELECT DISTINCT l_orderkey % 97 AS a_id, l_partkey AS item FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_suppkey AS b_id, l_partkey AS item FROM lineitem WHERE l_returnflag = 'A')"
_OVER = f"""{_SETS}, c AS (SELECT a_id, b_id, count(*) AS common FROM a JOIN b USING (item) GROUP BY 1, 2), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY common DESC, b_id) AS rn FROM c) WHERE rn = 1 AND common >= 3),
 o AS (SELECT a_id, b_id, common, common / (SELECT count(*) FROM a WHERE a.a_id = f.a_id) AS share_a, common / (SELECT count(*) FROM b WHERE b.b_id = f.b_id) AS share_b FROM f)"""


def _overlaps(t):
    li = t("lineitem")
    return M.best_overlaps(li.where("l_returnflag = 'R'").select((F.col("l_orderkey") % 97).alias("a_id"), F.col("l_partkey").alias("item")), li.where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("b_id"), F.col("l_partkey").alias("item")))


@query("n31_best_overlaps", f"WITH {_OVER} SELECT a_id, b_id, common, round(share_a, 8) AS share_a, round(share_b, 8) AS share_b FROM o")
def n31(t):
    return _overlaps(t).select("a_id", "b_id", "common", F.round("share_a", 8).alias("share_a"), F.round("share_b", 8).alias("share_b"))


@query("e30_votes", f"WITH {_OVER} SELECT a_id, b_id, CAST(a_id > b_id AS INT) AS vote_coherence, CAST(common > 5 AS INT) AS vote_cross, CAST(share_a >= share_b AS INT) AS vote_overlap, CAST(a_id > b_id AS INT) + CAST(common > 5 AS INT) + CAST(share_a >= share_b AS INT) AS votes FROM o")
def e30(t):
    o = _overlaps(t).withColumn("five", F.lit(5))
    return M.votes(o, "a_id", "b_id", "common", "five").select("a_id", "b_id", "vote_coherence", "vote_cross", "vote_overlap", "votes")


@query("n32_largest_cluster", f"WITH {CC}, m AS (SELECT DISTINCT file_name, repo_id FROM cc), z AS (SELECT repo_id, count(*) AS size FROM m GROUP BY 1) SELECT file_name, repo_id FROM (SELECT file_name, repo_id, row_number() OVER (PARTITION BY file_name ORDER BY size DESC, repo_id) AS rn FROM m JOIN z USING (repo_id)) WHERE rn = 1")
def n32(t):
    return M.largest_cluster_of(_cc(t).select("file_name", "repo_id").distinct(), "file_name", "repo_id")


@query("g8_largest_over_threshold", f"WITH {CC}, z AS (SELECT repo_id, count(*) AS size FROM cc GROUP BY 1) SELECT repo_id, size FROM z WHERE size > 8 ORDER BY size DESC, repo_id LIMIT 1")
def g8(t):
    return _cc(t).groupBy("repo_id").agg(F.count("*").alias("size")).where("size > 8").orderBy(F.desc("size"), "repo_id").limit(1)


@query("e31_missing_imports", f"""WITH {CC}, i AS (SELECT repo_id, file_path, unnest(map_keys(imports)) AS target FROM cc), k AS (SELECT DISTINCT repo_id, chunk_id AS target, 1 AS known FROM cc)
 SELECT repo_id, file_path, count(*) AS n_imports, count(*) FILTER (WHERE known IS NULL) AS n_missing FROM i LEFT JOIN k USING (repo_id, target) GROUP BY 1, 2""")
def e31(t):
    c = _cc(t)
    i = c.select("repo_id", "file_path", F.explode(F.map_keys("imports")).alias("target"))
    k = c.select("repo_id", F.col("chunk_id").alias("target")).distinct().withColumn("known", F.lit(1))
    return i.join(k, ["repo_id", "target"], "left").groupBy("repo_id", "file_path").agg(F.count("*").alias("n_imports"), F.count_if(F.col("known").isNull()).alias("n_missing"))


@query("e32_index_time", "SELECT round(regr_slope(time, repo_size), 10) AS slope, round(regr_intercept(time, repo_size), 6) AS intercept, regr_count(time, repo_size) AS n FROM repos")
def e32(t):
    return t("repos").agg(F.round(F.regr_slope("time", "repo_size"), 10).alias("slope"), F.round(F.regr_intercept("time", "repo_size"), 6).alias("intercept"), F.regr_count("time", "repo_size").alias("n"))
