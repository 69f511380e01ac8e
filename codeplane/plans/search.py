"""Vector search, set operations, edits and expressions bound to the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import search as R
from ..operators import sets as S
from ..operators import vectors as V
from ..operators import metrics as M
from ..sources.chunks import clean_chunks
from .common import CC, EXT, FP, TU
from .registry import query


def _cc(t):
    return clean_chunks(t("chunks"))


def _q0(t):
    row = t("embeddings").where("vec_id = 0").select("embedding").first()
    return list(row[0]) if row else []


_D0 = "pow(list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 2)"


@query("g1_top5", f"SELECT vec_id, label, round({_D0}, 4) AS distance FROM embeddings ORDER BY {_D0}, vec_id LIMIT 5")
def g1(t):
    return V.top_k(t("embeddings"), _q0(t), 5).select("vec_id", "label", F.round("distance", 4).alias("distance"))


@query("g1_knn_all", """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT query_id, vec_id, pow(list_distance(q, embedding::DOUBLE[]), 2) AS d FROM q, embeddings),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM d) SELECT query_id, vec_id, rank, round(d, 4) AS distance FROM r WHERE rank <= 10""")
def g1b(t):
    e = t("embeddings")
    return V.knn(e, e.where("vec_id % 100 = 0"), 10).select("query_id", "vec_id", "rank", F.round("distance", 4).alias("distance"))


@query("g2_store_query", f"SELECT label, min(round({_D0}, 4)) AS distance FROM (SELECT * FROM embeddings ORDER BY {_D0}, vec_id LIMIT 5) GROUP BY 1")
def g2(t):
    top = V.top_k(t("embeddings"), _q0(t), 5)
    return top.groupBy("label").agg(F.min(F.round("distance", 4)).alias("distance"))


@query("g3_post_filter", f"SELECT vec_id, round({_D0}, 4) AS distance FROM (SELECT * FROM embeddings ORDER BY {_D0}, vec_id LIMIT 20) WHERE label % 2 = 0")
def g3(t):
    return V.top_k(t("embeddings"), _q0(t), 20).where("label % 2 = 0").select("vec_id", F.round("distance", 4).alias("distance"))


@query("g3_pre_filter", f"SELECT vec_id, round({_D0}, 4) AS distance FROM embeddings WHERE label % 2 = 0 ORDER BY {_D0}, vec_id LIMIT 20")
def g3b(t):
    return V.top_k(t("embeddings"), _q0(t), 20, where="label % 2 = 0").select("vec_id", F.round("distance", 4).alias("distance"))


@query("g4_cluster_members", f"WITH h AS (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1), b AS (SELECT label, {_D0} AS d FROM h ORDER BY d, label LIMIT 1) SELECT e.vec_id, e.label, round(b.d, 4) AS distance FROM embeddings e JOIN b USING (label)")
def g4(t):
    """Members of the cluster whose first vector is nearest."""
    e = t("embeddings")
    heads = e.groupBy(F.col("label").alias("cluster_id")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    members = e.select(F.col("label").alias("cluster_id"), F.col("vec_id").alias("chunk_id"))
    best = V.cluster_of_best(heads, _q0(t), members)
    return best.select(F.col("chunk_id").alias("vec_id"), F.col("cluster_id").alias("label"), F.round("distance", 4).alias("distance"))


@query("g5_plain_top3", f"SELECT vec_id, round({_D0}, 4) AS distance FROM embeddings ORDER BY {_D0}, vec_id LIMIT 3")
def g5(t):
    return V.top_k(t("embeddings"), _q0(t), 3).select("vec_id", F.round("distance", 4).alias("distance"))


@query("g6_reranked_paths")
def g6(t):
    return R.reranked(_cc(t).select("file_path").distinct(), "src/walker/cache.js")


@query("g9_offset_limit", "SELECT call_id, model FROM token_usage ORDER BY call_id, arrived_at LIMIT 10 OFFSET 20")
def g9(t):
    return t("token_usage").orderBy("call_id", "arrived_at").offset(20).limit(10).select("call_id", "model")


@query("g12_prefix_samples", f"WITH {CC}, r AS (SELECT repo_id, file_path, ord, row_number() OVER (PARTITION BY repo_id ORDER BY file_path, ord) AS n, count(*) OVER (PARTITION BY repo_id) AS c FROM cc) SELECT p, repo_id, count(*) AS n FROM r, (VALUES (0.25::DOUBLE), (0.5), (0.75)) v(p) WHERE n <= floor(c * p) GROUP BY 1, 2")
def g12(t):
    w = Window.partitionBy("repo_id")
    r = _cc(t).select("repo_id", F.row_number().over(w.orderBy("file_path", "ord")).alias("n"), F.count("*").over(w).alias("c"))
    return r.withColumn("p", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).where(F.col("n") <= F.floor(F.col("c") * F.col("p"))).groupBy("p", "repo_id").agg(F.count("*").alias("n"))


@query("g13_initial_context", f"""WITH h AS (SELECT vec_id AS id, label AS file_path, {_D0} AS distance FROM embeddings), a AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY distance, id) AS g FROM h), b AS (SELECT *, row_number() OVER (ORDER BY distance, id) AS n_all FROM a WHERE g <= 5)
 SELECT id, file_path, n_all FROM b WHERE n_all <= 50""")
def g13(t):
    e = t("embeddings")
    q = F.array(*[F.lit(float(x)) for x in _q0(t)])
    h = e.select(F.col("vec_id").alias("id"), F.col("label").alias("file_path"), X.squared_l2(F.col("embedding"), q).alias("distance"))
    return R.initial_context(h, []).select("id", "file_path", "n_all")


@query("g14_two_arm", f"WITH c AS (SELECT vec_id AS id, {_D0} AS distance FROM embeddings WHERE label % 2 = 0 ORDER BY distance, id LIMIT 4), k AS (SELECT vec_id AS id, {_D0} AS distance FROM embeddings WHERE label % 2 = 1) SELECT id, round(distance, 4) AS distance, 25 AS tokens FROM (SELECT * FROM c UNION ALL SELECT * FROM k)")
def g14(t):
    q = F.array(*[F.lit(float(x)) for x in _q0(t)])
    h = t("embeddings").select(F.col("vec_id").alias("id"), X.squared_l2(F.col("embedding"), q).alias("distance"), "label")
    return R.two_arm(h.where("label % 2 = 0").drop("label"), h.where("label % 2 = 1").drop("label")).withColumn("distance", F.round("distance", 4))


@query("g15_requests", "WITH h AS (SELECT event_type AS request, event_id AS place FROM events) SELECT request, place FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY place) AS r FROM h) WHERE r <= floor(100 / (SELECT count(DISTINCT request) FROM h))")
def g15(t):
    return R.search_requests(t("events").select(F.col("event_type").alias("request"), F.col("event_id").alias("place")), 100)


@query("g16_exploded_hits", f"WITH {CC} SELECT repo_id, file_path, ord, unnest(span_ids) AS span_id FROM cc WHERE category = 'implementation'")
def g16(t):
    return _cc(t).where("category = 'implementation'").select("repo_id", "file_path", "ord", F.explode("span_ids").alias("span_id"))


@query("n20_hits_to_files", f"SELECT label AS file_path, min(round({_D0}, 4)) AS distance FROM embeddings GROUP BY 1")
def n20(t):
    e = t("embeddings")
    q = F.array(*[F.lit(float(x)) for x in _q0(t)])
    hits = e.select(F.col("vec_id").alias("id"), F.lit("chunk").alias("type"), F.array("vec_id").alias("chunk_ids"), F.round(X.squared_l2(F.col("embedding"), q), 4).alias("distance"))
    return V.hits_to_files(hits, e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("file_path")))


@query("n21_spans_of_hits", f"""WITH {CC}, h AS (SELECT concat(repo_id, ':', file_path, ':', ord) AS hit, concat(repo_id, ':', file_path) AS f, CASE WHEN ord % 2 = 1 THEN span_ids ELSE ['none'] END AS ids, start_line AS a, end_line AS b FROM cc),
 s AS (SELECT DISTINCT concat(repo_id, ':', file_path) AS f, unnest(span_ids) AS span_id, start_line AS s, end_line AS e FROM cc), n AS (SELECT DISTINCT hit, f, span_id FROM (SELECT hit, f, unnest(ids) AS span_id FROM h) x SEMI JOIN s USING (f, span_id)),
 r AS (SELECT * FROM h ANTI JOIN n USING (hit)) SELECT hit, f AS file_path, span_id FROM n UNION SELECT r.hit, r.f, s.span_id FROM r JOIN s USING (f) WHERE NOT (r.b < s.s OR r.a > s.e)""")
def n21(t):
    c = _cc(t).withColumn("f", F.concat_ws(":", "repo_id", "file_path"))
    hits = c.select(F.concat_ws(":", "f", "ord").alias("hit"), F.col("f").alias("file_path"), F.when(F.col("ord") % 2 == 1, F.col("span_ids")).otherwise(F.array(F.lit("none"))).alias("span_ids"), "start_line", "end_line")
    spans = c.select(F.col("f").alias("file_path"), F.explode("span_ids").alias("span_id"), F.col("start_line").alias("s"), F.col("end_line").alias("e")).distinct()
    return R.spans_of_hits(hits, spans)


@query("n22_spans_by_lines", f"WITH {CC}, b AS (SELECT repo_id, file_path, unnest(span_ids) AS span_id, start_line, end_line FROM cc) SELECT DISTINCT b.repo_id, b.file_path, r.s, r.e, b.span_id FROM b JOIN (SELECT DISTINCT repo_id, file_path, 10 AS s, 30 AS e FROM cc) r USING (repo_id, file_path) WHERE NOT (end_line < r.s OR start_line > r.e)")
def n22(t):
    c = _cc(t)
    r = c.select("repo_id", "file_path", F.lit(10).alias("s"), F.lit(30).alias("e")).distinct()
    return R.spans_by_lines(c.select("repo_id", "file_path", F.explode("span_ids").alias("span_id"), "start_line", "end_line"), r, ["repo_id", "file_path"])


@query("n25_missing_files", f"WITH {CC}, g AS (SELECT DISTINCT id AS repo_id, unnest(cluster_files) AS f FROM repos), h AS (SELECT DISTINCT repo_id, array_to_string(list_slice(string_split(file_path, '/'), -2, -1), '/') AS f FROM cc) SELECT repo_id, f FROM g ANTI JOIN h USING (repo_id, f)")
def n25(t):
    parts = F.split("file_path", "/")
    h = _cc(t).select("repo_id", F.array_join(F.when(F.size(parts) > 1, F.slice(parts, -2, 2)).otherwise(parts), "/").alias("f"))
    return S.missing(t("repos").select(F.col("id").alias("repo_id"), F.explode("cluster_files").alias("f")).distinct(), h, ["repo_id", "f"])


@query("n26_all_found", f"WITH {CC}, g AS (SELECT DISTINCT id AS repo_id, unnest(cluster_files) AS f FROM repos), h AS (SELECT DISTINCT repo_id, array_to_string(list_slice(string_split(file_path, '/'), -2, -1), '/') AS f, true AS hit FROM cc) SELECT repo_id, bool_and(coalesce(hit, false)) AS all_found FROM g LEFT JOIN h USING (repo_id, f) GROUP BY 1")
def n26(t):
    parts = F.split("file_path", "/")
    h = _cc(t).select("repo_id", F.array_join(F.when(F.size(parts) > 1, F.slice(parts, -2, 2)).otherwise(parts), "/").alias("f"))
    return S.all_found(t("repos").select(F.col("id").alias("repo_id"), F.explode("cluster_files").alias("f")).distinct(), h, "repo_id", ["f"])


_VERS = "o AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS v FROM lineitem WHERE l_linenumber < 5), w AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_tax > 0.06 THEN l_quantity + 1 ELSE l_quantity END AS v FROM lineitem WHERE l_linenumber > 1)"


def _versions(t):
    li = t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("v"), "l_tax")
    return li.where("n < 5").drop("l_tax"), li.where("n > 1").withColumn("v", F.when(F.col("l_tax") > 0.06, F.col("v") + 1).otherwise(F.col("v"))).drop("l_tax")


@query("n28_changed", f"WITH {_VERS} SELECT k, n, CASE WHEN o.v IS NULL THEN 'added' WHEN w.v IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN w USING (k, n) WHERE o.v IS DISTINCT FROM w.v")
def n28(t):
    o, w = _versions(t)
    return S.changed(o, w, ["k", "n"], "v")


@query("n29_new_ids", f"WITH {_VERS} SELECT k, n FROM w EXCEPT SELECT k, n FROM o")
def n29(t):
    o, w = _versions(t)
    return S.missing(w.select("k", "n").distinct(), o, ["k", "n"])


@query("i10_ingest_diff", f"WITH {_VERS} SELECT k, n, CASE WHEN o.v IS NULL THEN 'insert' WHEN w.v IS NULL THEN 'delete' WHEN o.v = w.v THEN 'unchanged' ELSE 'update' END AS action FROM o FULL JOIN w USING (k, n)")
def i10(t):
    o, w = _versions(t)
    h = lambda x: x.withColumn("hash", X.text_hash(F.col("v").cast("string")))
    return V.ingest_diff(h(o), h(w), ["k", "n"])


@query("n33_repos_own_first", "SELECT DISTINCT coalesce(a.id, b.id) AS id, coalesce(a.repo_name, b.repo_name) AS repo_name FROM (SELECT id, repo_name FROM repos WHERE id % 2 = 0) a FULL JOIN (SELECT id, repo_name FROM repos) b ON a.id = b.id")
def n33(t):
    r = t("repos").select("id", "repo_name")
    a, b = r.where("id % 2 = 0").select("id", F.col("repo_name").alias("a")), r.select("id", F.col("repo_name").alias("b"))
    return a.join(b, "id", "full_outer").select("id", F.coalesce("a", "b").alias("repo_name")).distinct()


@query("n34_known_labels", f"WITH {CC}, l AS (SELECT repo_id, file_path, ord, unnest(map_keys(imports)) AS name FROM cc) SELECT l.repo_id, file_path, ord, name FROM l SEMI JOIN (SELECT repo_id, chunk_id AS name FROM cc) k ON l.repo_id = k.repo_id AND l.name = k.name")
def n34(t):
    c = _cc(t)
    return c.select("repo_id", "file_path", "ord", F.explode(F.map_keys("imports")).alias("name")).join(c.select("repo_id", F.col("chunk_id").alias("name")).distinct(), ["repo_id", "name"], "left_semi").select("repo_id", "file_path", "ord", "name")


@query("n35_group_pairs", "SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_name < b.r_name")
def n35(t):
    r = t("region")
    return r.select(F.col("r_name").alias("a")).join(r.select(F.col("r_name").alias("b")), F.col("a") < F.col("b"))


@query("n36_residual", f"WITH {CC} SELECT repo_id, file_path, ord FROM cc WHERE NOT coalesce(category = 'test', false) AND NOT (file_path LIKE '%.py') AND NOT (file_path LIKE '%.js')")
def n36(t):
    c = _cc(t).select("repo_id", "file_path", "ord", "category")
    keys = ["repo_id", "file_path", "ord"]
    return S.residual(c, [c.where("category = 'test'"), c.where("file_path LIKE '%.py'"), c.where("file_path LIKE '%.js'")], keys).select(*keys)


@query("n37_non_empty", "SELECT id, len(cluster_files) AS n FROM repos WHERE len(cluster_files) > 0")
def n37(t):
    return t("repos").where("size(cluster_files) > 0").select("id", F.size("cluster_files").alias("n"))


_OPS = "ops AS (SELECT event_id AS seq, CASE WHEN event_type IN ('click', 'view') THEN 'MoveOp' ELSE 'CreateOp' END AS op_type, user_id % 10 AS src, CAST(floor(value) AS INT) AS chunk FROM events)"


def _ops(t):
    return t("events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type").isin("click", "view"), "MoveOp").otherwise("CreateOp").alias("op_type"), (F.col("user_id") % 10).alias("src"), F.floor("value").cast("int").alias("chunk"))


@query("i4_conflict_free", f"WITH {_OPS} SELECT seq, op_type, src, chunk FROM (SELECT *, count(*) FILTER (WHERE op_type = 'MoveOp') OVER (PARTITION BY src, chunk) AS n FROM ops) WHERE op_type <> 'MoveOp' OR n = 1")
def i4(t):
    return S.conflict_free(_ops(t), ["src", "chunk"])


@query("i5_conflict_free_chunk", f"WITH {_OPS} SELECT seq, op_type, src, chunk FROM (SELECT *, count(*) FILTER (WHERE op_type = 'MoveOp') OVER (PARTITION BY chunk) AS n FROM ops) WHERE op_type <> 'MoveOp' OR n = 1")
def i5(t):
    return S.conflict_free(_ops(t), ["chunk"])


_MV = "m AS (SELECT o_orderkey AS chunk_id, o_custkey % 20 AS cluster_id FROM orders), mv AS (SELECT o_orderkey AS chunk_id, o_custkey % 20 AS src, (o_custkey + o_orderkey) % 23 AS dst FROM orders WHERE o_orderkey % 7 = 0)"


@query("i1_moved", f"WITH {_MV}, k AS (SELECT DISTINCT cluster_id FROM m), v AS (SELECT * FROM mv WHERE src IN (SELECT cluster_id FROM k) AND dst IN (SELECT cluster_id FROM k)) SELECT chunk_id, cluster_id FROM m ANTI JOIN v ON m.chunk_id = v.chunk_id AND m.cluster_id = v.src UNION SELECT chunk_id, dst FROM v")
def i1(t):
    o = t("orders")
    m = o.select(F.col("o_orderkey").alias("chunk_id"), (F.col("o_custkey") % 20).alias("cluster_id"))
    mv = o.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("chunk_id"), (F.col("o_custkey") % 20).alias("src_cluster"), ((F.col("o_custkey") + F.col("o_orderkey")) % 23).alias("dst_cluster"))
    return S.moved(m, mv, m)


@query("i2_adopted", "SELECT n_nationkey AS child_id, n_regionkey AS parent_id FROM nation UNION SELECT n_nationkey, (n_nationkey + 3) % 25 FROM nation WHERE n_nationkey % 4 = 0")
def i2(t):
    n = t("nation")
    known = n.select(F.col("n_nationkey").alias("cluster_id"))
    tree = n.select(F.col("n_nationkey").alias("child_id"), F.col("n_regionkey").alias("parent_id"))
    return S.adopted(tree, n.where("n_nationkey % 4 = 0").select(F.col("n_nationkey").alias("child_id"), ((F.col("n_nationkey") + 3) % 25).cast("int").alias("parent_id")), known)


@query("i3_created", "SELECT r_regionkey AS cluster_id, r_name AS title FROM region UNION ALL SELECT 100, 'new'")
def i3(t):
    r = t("region").select(F.col("r_regionkey").alias("cluster_id"), F.col("r_name").alias("title"))
    return S.created(r, r.limit(1).select(F.lit(100).alias("cluster_id"), F.lit("new").alias("title")).unionByName(r.limit(1)))


@query("i6_split", "SELECT s_suppkey AS chunk_id, CASE WHEN s_nationkey = 3 AND s_acctbal > 0 THEN concat(s_nationkey, '/rich') ELSE CAST(s_nationkey AS VARCHAR) END AS cluster_id FROM supplier")
def i6(t):
    m = t("supplier").select(F.col("s_suppkey").alias("chunk_id"), F.col("s_nationkey").alias("cluster_id"), "s_acctbal")
    return S.split_members(m.drop("s_acctbal"), m.where("cluster_id = 3 AND s_acctbal > 0").select("chunk_id", "cluster_id", F.lit("rich").alias("topic")))


@query("i7_removed", "SELECT s_suppkey, s_nationkey FROM supplier ANTI JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) d USING (s_suppkey)")
def i7(t):
    s = t("supplier")
    return S.missing(s.select("s_suppkey", "s_nationkey"), s.where("s_acctbal < 0"), ["s_suppkey"])


@query("i8_added_vectors", "SELECT vec_id, label FROM embeddings UNION ALL SELECT (SELECT max(vec_id) FROM embeddings) + row_number() OVER (ORDER BY s_suppkey), NULL FROM supplier")
def i8(t):
    store = t("embeddings").select("vec_id", "label", F.lit(None).cast("bigint").alias("ref_id"))
    return V.add_vectors(store, t("supplier").select(F.col("s_suppkey").alias("ref_id"))).select("vec_id", "label")


@query("i9_deleted_vectors", "SELECT vec_id FROM embeddings WHERE label NOT IN (SELECT r_regionkey FROM region)")
def i9(t):
    return V.apply_deletes(t("embeddings").withColumnRenamed("label", "ref_id"), t("region").select(F.col("r_regionkey").alias("ref_id"))).select("vec_id")


@query("i11_union", "SELECT s_suppkey AS id, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def i11(t):
    return S.union_all([t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")), t("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))])


@query("i12_file_spans", f"WITH {CC} SELECT repo_id, file_path, list_sort(list(DISTINCT s)) AS spans FROM (SELECT repo_id, file_path, unnest(span_ids) AS s FROM cc) GROUP BY 1, 2")
def i12(t):
    return S.file_spans(_cc(t).select("repo_id", "file_path", F.explode("span_ids").alias("s")), ["repo_id", "file_path"], "s")


@query("i13_context_set", f"WITH {CC}, a AS (SELECT repo_id, file_path, unnest(span_ids) AS s FROM cc WHERE input_type = 'chunk'), r AS (SELECT repo_id, file_path, unnest(span_ids) AS s FROM cc WHERE category = 'test') SELECT repo_id, file_path, s FROM a EXCEPT SELECT repo_id, file_path, s FROM r")
def i13(t):
    c = _cc(t)
    x = lambda which: c.where(which).select("repo_id", "file_path", F.explode("span_ids").alias("s")).distinct()
    return S.missing(x("input_type = 'chunk'"), x("category = 'test'"), ["repo_id", "file_path", "s"])


@query("i17_cache_upsert", f"WITH {TU}, k AS (SELECT function_name, model, chunk_id, call_id, created_at, row_number() OVER (PARTITION BY function_name, model, chunk_id ORDER BY created_at DESC, call_id DESC) AS n FROM tu WHERE chunk_id IS NOT NULL AND model IS NOT NULL) SELECT function_name, model, chunk_id, call_id FROM k WHERE n = 1")
def i17(t):
    c = M.latest_calls(t("token_usage")).where("chunk_id IS NOT NULL AND model IS NOT NULL").select("function_name", "model", "chunk_id", "call_id", F.struct("created_at", "call_id").alias("o"))
    return S.upserted(c.where("call_id % 2 = 0"), c.where("call_id % 2 = 1"), ["function_name", "model", "chunk_id"], "o").select("function_name", "model", "chunk_id", "call_id")


@query("i18_reference_counted", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) = 1)")
def i18(t):
    once = t("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).count().where("count = 1")
    return S.missing(t("nation").select("n_nationkey"), once, ["n_nationkey"])


@query("i19_within_size", "SELECT r_regionkey AS k FROM region UNION ALL SELECT n_nationkey FROM nation WHERE (SELECT count(*) FROM nation) BETWEEN 1 AND 30")
def i19(t):
    return S.within_size(t("region").select(F.col("r_regionkey").alias("k")).unionAll(t("nation").select("n_nationkey")), 1, 30)


@query("i23_partial_update", "SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN 'renamed' END, s_name) AS s_name, s_nationkey FROM supplier")
def i23(t):
    s = t("supplier").select("s_suppkey", "s_name", "s_nationkey")
    return S.partial_update(s, s.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "renamed").alias("s_name"), F.lit(1).alias("unknown")), "s_suppkey")


@query("h14_balanced_groups")
def h14(t):
    return S.balanced_groups(t("supplier").groupBy(F.col("s_nationkey").alias("id")).agg(F.count("*").alias("size")))


@query("i20_residual_share", f"WITH {CC} SELECT repo_id, round(count(*) FILTER (WHERE len(map_keys(imports)) = 0) / count(*), 8) AS left_share FROM cc GROUP BY 1")
def i20(t):
    return _cc(t).groupBy("repo_id").agg(F.round(F.count_if(F.size(F.map_keys("imports")) == 0) / F.count("*"), 8).alias("left_share"))
