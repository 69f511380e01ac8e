"""Lookups, predicates, tree edits, renderings and stores bound to the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import extract as B
from ..operators import graphs as G
from ..operators import metrics as M
from ..operators import patches as P
from ..operators import render as D
from ..operators import scopes as N
from ..operators import trees as T
from ..operators import vectors as V
from ..sources import io, store
from ..sources.chunks import clean_chunks, files
from .code import SYSTEM, THIRD_PARTY, _caps, _imports, _local, _py
from .common import CC, TU
from .registry import query
from .search import _D0, _q0


def _cc(t):
    return clean_chunks(t("chunks"))


# ------------------------------------------------------------------------------- sources and sinks
@query("a7_looked_up_files", f"WITH {CC}, w AS (SELECT DISTINCT repo_id, chunk_id FROM token_usage) SELECT repo_id, file_path, count(*) AS n_chunks FROM cc SEMI JOIN w USING (repo_id, chunk_id) WHERE NOT regexp_matches(file_path, '^(?:.*/)?tests?/.*$') GROUP BY 1, 2")
def a7(t):
    """The files that calls asked for, outside of excluded folders."""
    w = t("token_usage").select("repo_id", "chunk_id").distinct()
    c = _cc(t).where(~X.matches_any(F.col("file_path"), ["**/test/**", "**/tests/**"]))
    return c.join(w, ["repo_id", "chunk_id"], "left_semi").groupBy("repo_id", "file_path").agg(F.count("*").alias("n_chunks"))


@query("a12_persisted_vectors", "SELECT vec_id, label FROM embeddings WHERE label NOT IN (SELECT r_regionkey FROM region)")
def a12(t):
    """Vectors written without those of deleted documents, and read again."""
    e = t("embeddings")
    path = store.shared_folder(e.sparkSession)
    store.persist_vectors(e.withColumnRenamed("label", "ref_id"), path, t("region").select(F.col("r_regionkey").alias("ref_id")))
    return store.read_vectors(e.sparkSession, path).select("vec_id", F.col("ref_id").alias("label"))


@query("a14_restored_bundle", f"WITH {CC} SELECT 'chunks' AS table_name, count(*) AS n FROM cc UNION ALL SELECT 'vectors', count(*) FROM embeddings UNION ALL SELECT 'repos', count(*) FROM repos")
def a14(t):
    """Rows of the tables of an index after it was written and read again."""
    spark = t("repos").sparkSession
    path = store.shared_folder(spark)
    store.persist_bundle({"chunks": _cc(t).select("repo_id", "file_path", "ord"), "vectors": t("embeddings"), "repos": t("repos").select("id", "owner")}, path)
    frames = store.restore_bundle(spark, path, ["chunks", "vectors", "repos"])
    return frames["chunks"].agg(F.count("*").alias("n")).select(F.lit("chunks").alias("table_name"), "n").unionAll(frames["vectors"].agg(F.count("*").alias("n")).select(F.lit("vectors"), "n")).unionAll(frames["repos"].agg(F.count("*").alias("n")).select(F.lit("repos"), "n"))


@query("a18_json_lines", "SELECT doc_id, label FROM quality_labels")
def a18(t):
    """Rows appended as JSON lines in two steps, and read with a schema."""
    q = t("quality_labels").select("doc_id", "label")
    path = store.shared_folder(q.sparkSession)
    io.append_jsonl(q.where("doc_id % 2 = 0"), path)
    io.append_jsonl(q.where("doc_id % 2 <> 0 OR doc_id IS NULL"), path)
    return io.read_jsonl(q.sparkSession, path, "doc_id BIGINT, label STRING")


@query("a19_csv_report", "SELECT r_name, replace(printf('%.4f', r_regionkey / 8), '.', ',') AS share FROM region")
def a19(t):
    """A report with quoted fields and a comma as decimal mark, as it reads."""
    r = t("region").select("r_name", (F.col("r_regionkey") / 8).alias("share"))
    path = store.shared_folder(r.sparkSession)
    io.write_report(r, path)
    return r.sparkSession.read.option("header", True).schema("r_name STRING, share STRING").csv(path)


@query("a10_node_link_source", "SELECT n_regionkey AS source, n_nationkey AS target FROM nation")
def a10(t):
    """The links of a node-link document that was written and read again."""
    doc = io.to_node_link(t("region").select(F.col("r_regionkey").alias("id"), "r_name"), t("nation").select(F.col("n_regionkey").alias("source"), F.col("n_nationkey").alias("target")))
    path = store.shared_folder(doc.sparkSession)
    doc.select(F.col("json").alias("value")).write.text(path)
    links = doc.sparkSession.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "links ARRAY<STRUCT<source: INT, target: INT>>")["links"]).alias("l"))
    return links.select("l.source", "l.target")


@query("a11_load_or_build", f"WITH {CC} SELECT repo_id, count(*) AS n FROM cc GROUP BY 1")
def a11(t):
    """A table that is built, written and then read; the second call finds it."""
    c = _cc(t)
    path = store.shared_folder(c.sparkSession)
    build = lambda: c.groupBy("repo_id").agg(F.count("*").alias("n"))
    io.load_or_build(c.sparkSession, path, build)
    return io.load_or_build(c.sparkSession, path, lambda: 1 / 0)


@query("a24_truncated", "SELECT 'region' AS table_name, true AS confirmed, 0 AS n UNION ALL SELECT 'nation', false, count(*) FROM nation")
def a24(t):
    r, n = store.truncated(t("region"), True), store.truncated(t("nation"), False)
    return r.agg(F.count("*").alias("n")).select(F.lit("region").alias("table_name"), F.lit(True).alias("confirmed"), "n").unionAll(n.agg(F.count("*").alias("n")).select(F.lit("nation"), F.lit(False), "n"))


@query("a28_modules")
def a28(t):
    """Modules that come with the language or that others publish."""
    return t("region").sparkSession.createDataFrame([(m, "system") for m in SYSTEM] + [(m, "third_party") for m in THIRD_PARTY], "module STRING, import_kind STRING")


@query("a32_added_to_all", "SELECT 'region' AS table_name, count(*) AS n, sum(0.5) AS total FROM region UNION ALL SELECT 'nation', count(*), sum(0.5) FROM nation")
def a32(t):
    made = store.with_column_in_all({"region": t("region"), "nation": t("nation"), "missing": None}, "weight", "REAL", "0.5")
    one = lambda n: made[n].agg(F.count("*").alias("n"), F.sum("weight").alias("total")).select(F.lit(n).alias("table_name"), "n", "total")
    return one("region").unionAll(one("nation"))


# ------------------------------------------------------------------------------------- extraction
@query("b4_java_blocks")
def b4(t):
    return B.java_blocks(files(t("chunks"), ("java",))).select("repo_id", "file_path", "block", "parent", "type", "identifier", "path", "start_line", "end_line")


@query("b19_patch_files")
def b19(t):
    """Files that a stored patch touches."""
    return B.hunks(files(t("chunks")).where("content LIKE '%@@ -%'"), ["repo_id", "file_path"]).select("repo_id", "file_path", "file").distinct()


@query("b25_fenced", "SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?s)```json(.*)```', 1), ''), text) AS body FROM documents")
def b25(t):
    return t("documents").select("doc_id", X.fenced(F.col("text"), "json").alias("body"))


@query("b20_compiler_errors", "SELECT doc_id, len(regexp_extract_all(text, '(?m)^(\\S+?):(\\d+):(?:\\d+:)? error: (.*)$', 1)) AS n FROM documents WHERE text IS NOT NULL")
def b20(t):
    return t("documents").where("text IS NOT NULL").select("doc_id", F.size(B.log_errors(F.col("text"))).alias("n"))


# ------------------------------------------------------------------------ expressions and predicates
_PAIR = f"{CC}, p AS (SELECT repo_id, file_path, ord, start_line AS a, end_line AS b, lead(start_line) OVER (PARTITION BY repo_id, file_path ORDER BY ord) AS c, lead(end_line) OVER (PARTITION BY repo_id, file_path ORDER BY ord) AS d FROM cc)"


@query("c6_bytes_and_shifts", f"WITH {_PAIR} SELECT repo_id, file_path, ord, a * 10 <= c * 10 AND d * 10 <= b * 10 AS holds, a + 5 AS start_row, b + 5 AS end_row, a <= c AND d <= b AS covers, a >= c AND b <= d AS within_ FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL")
def c6(t):
    """Byte containment, shifted ranges and full overlap of neighbouring chunks."""
    w = Window.partitionBy("repo_id", "file_path").orderBy("ord")
    p = _cc(t).select("repo_id", "file_path", "ord", F.col("start_line").alias("a"), F.col("end_line").alias("b"), F.lead("start_line").over(w).alias("c"), F.lead("end_line").over(w).alias("d")).where("a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL")
    r = [F.col(x) for x in "abcd"]
    moved = X.shift(F.struct(r[0].alias("start_row"), r[1].alias("end_row")), 5)
    return p.select("repo_id", "file_path", "ord", X.contains_bytes(*[x * 10 for x in r]).alias("holds"), moved["start_row"].alias("start_row"), moved["end_row"].alias("end_row"), X.contains_lines(*r).alias("covers"), X.within_lines(*r).alias("within_"))


@query("c14_globs", f"WITH {CC} SELECT DISTINCT repo_id, file_path, regexp_matches(file_path, '^(?:.*/)?[^/]*\\.py$') OR regexp_matches(file_path, '^src/.*$') AS in_union FROM cc WHERE NOT (regexp_matches(file_path, '^(?:.*/)?node_modules/.*$') OR regexp_matches(file_path, '^(?:.*/)?[^/]*\\.lock$'))")
def c14(t):
    """Files outside of a repository's exclusions, and whether a union of globs holds them."""
    f = _cc(t).select("repo_id", "file_path").distinct().where(~X.matches_any(F.col("file_path"), ["**/node_modules/**", "**/*.lock"]))
    return f.select("repo_id", "file_path", X.matches_any(F.col("file_path"), ["**/*.py", "src/**"]).alias("in_union"))


_EDGE = f"{CC}, e AS (SELECT repo_id, chunk_id AS src, unnest(map_keys(imports)) AS dst, 'imports' AS kind FROM cc UNION ALL SELECT repo_id, chunk_id, lead(chunk_id) OVER (PARTITION BY repo_id, file_path ORDER BY ord), 'precedes' FROM cc)"


def _kinds(t):
    c = _cc(t)
    w = Window.partitionBy("repo_id", "file_path").orderBy("ord")
    return c.select("repo_id", F.col("chunk_id").alias("src"), F.explode(F.map_keys("imports")).alias("dst"), F.lit("imports").alias("kind")).unionAll(c.select("repo_id", "chunk_id", F.lead("chunk_id").over(w), F.lit("precedes")))


@query("c18_edges_by_kind", f"WITH {_EDGE} SELECT repo_id, src, dst FROM e WHERE kind = 'precedes' AND dst IS NOT NULL")
def c18(t):
    return T.edges_of(_kinds(t), ["precedes"]).where("dst IS NOT NULL").select("repo_id", "src", "dst")


@query("c28_edges_between", f"WITH {_EDGE} SELECT repo_id, src, dst, count(DISTINCT kind) AS n_kinds, count(*) AS n FROM e WHERE kind IN ('imports', 'precedes') AND dst IS NOT NULL GROUP BY 1, 2, 3")
def c28(t):
    return T.edges_of(_kinds(t), ["imports", "precedes"]).where("dst IS NOT NULL").groupBy("repo_id", "src", "dst").agg(F.count_distinct("kind").alias("n_kinds"), F.count("*").alias("n"))


@query("c19_nodes_of_type")
def c19(t):
    """Definitions, imports and references of each scope."""
    _, _, rows, _, _ = _local(t)
    return rows.groupBy("repo_id", "file_path", "scope_id", "kind").agg(F.count("*").alias("n"), F.count_distinct("name").alias("n_names"))


@query("c22_instances", "SELECT DISTINCT id, len(cluster_files) AS n_solvers FROM repos WHERE len(cluster_files) >= 3")
def c22(t):
    """Instances with three solvers or more, those with most first."""
    return t("repos").where("size(cluster_files) >= 3").select("id", F.size("cluster_files").alias("n_solvers")).distinct().orderBy(F.desc("n_solvers"), "id")


@query("c24_without_content", f"WITH {CC} SELECT repo_id, file_path, ord, chunk_id, start_line, end_line FROM cc")
def c24(t):
    return _cc(t).select("repo_id", "file_path", "ord", "chunk_id", "start_line", "end_line")


@query("c26_has_span", f"WITH {CC}, w AS (SELECT repo_id, list(DISTINCT name) AS names FROM (SELECT repo_id, unnest(flatten(map_values(imports))) AS name FROM cc) GROUP BY 1) SELECT repo_id, file_path, ord, coalesce(list_has_any(span_ids, names), false) AS has_any FROM cc LEFT JOIN w USING (repo_id)")
def c26(t):
    """Whether a chunk holds a span that a chunk of its repository imports; by names, so that no repository's names meet in one row."""
    c = _cc(t).select("repo_id", "file_path", "ord", "span_ids", "imports")
    wanted = c.select("repo_id", F.explode(F.flatten(F.map_values("imports"))).alias("span")).distinct()
    hit = c.select("repo_id", "file_path", "ord", F.explode("span_ids").alias("span")).join(wanted, ["repo_id", "span"], "left_semi").select("repo_id", "file_path", "ord").distinct().withColumn("hit", F.lit(True))
    return c.select("repo_id", "file_path", "ord").join(hit, ["repo_id", "file_path", "ord"], "left").select("repo_id", "file_path", "ord", F.coalesce("hit", F.lit(False)).alias("has_any"))


@query("c29_transitions", "SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_errors, count(*) FILTER (WHERE event_type = 'purchase') AS n_purchases FROM events GROUP BY 1")
def c29(t):
    """Transitions of every run, all and by the name of their state."""
    return t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.count_if(F.col("event_type") == "purchase").alias("n_purchases"))


@query("c31_spans_by_id", f"WITH {CC}, w AS (SELECT DISTINCT repo_id, unnest(flatten(map_values(imports))) AS span_id FROM cc), s AS (SELECT repo_id, file_path, ord, unnest(span_ids) AS span_id FROM cc) SELECT DISTINCT s.* FROM s SEMI JOIN w USING (repo_id, span_id)")
def c31(t):
    c = _cc(t)
    w = c.select("repo_id", F.explode(F.flatten(F.map_values("imports"))).alias("span_id")).distinct()
    return c.select("repo_id", "file_path", "ord", F.explode("span_ids").alias("span_id")).join(w, ["repo_id", "span_id"], "left_semi").select("repo_id", "file_path", "ord", "span_id").distinct()


@query("c32_first_of_type", f"WITH {CC} SELECT repo_id, file_path, min(ord) AS ord FROM cc WHERE category = 'test' GROUP BY 1, 2")
def c32(t):
    return T.first_of_type(_cc(t).select("repo_id", "file_path", "ord", "category"), F.col("category") == "test", ["ord"]).select("repo_id", "file_path", "ord")


_LL = f"{CC}, ll AS (SELECT repo_id, file_path, unnest(string_split(content, chr(10))) AS line FROM cc WHERE content IS NOT NULL)"


@query("c33_complete_files", f"""WITH {_LL}, g AS (SELECT repo_id, file_path, count(*) FILTER (WHERE regexp_matches(line, '^\\s*(#|//)') AND (starts_with(regexp_replace(trim(regexp_replace(line, chr(13) || '$', '')), '^//', '#'), '# ...') OR regexp_matches(line, '(?i)rest of the code|existing code|other code'))) AS n_gaps FROM ll GROUP BY 1, 2)
 SELECT repo_id, file_path, n_gaps, n_gaps = 0 AS is_complete FROM g""")
def c33(t):
    return T.complete_files(B.numbered_lines(_cc(t).where("content IS NOT NULL").select("repo_id", "file_path", "content")))


@query("c39_column_defaults", "SELECT n_nationkey, 0::BIGINT AS a_integer, '' AS a_text, 0.0::DOUBLE AS a_real, false AS a_boolean FROM nation")
def c39(t):
    df = t("nation").select("n_nationkey")
    for kind in ("INTEGER", "TEXT", "REAL", "BOOLEAN"):
        df = io.with_column(df, "a_" + kind.lower(), kind)
    return df


# ---------------------------------------------------------------------------- scopes and references
@query("n6_calls_with_refs")
def n6(t):
    """Per file the calls and those whose lines hold a reference of their name."""
    c = N.call_refs(_caps(t))
    return c.groupBy("repo_id", "file_path").agg(F.count("*").alias("n_calls"), F.count("ref").alias("n_with_ref"))


@query("n9_import_uses")
def n9(t):
    """Scopes that refer to an imported name."""
    rows = _local(t)[2]
    i = rows.where("kind = 'import'").select("repo_id", "file_path", "name").distinct()
    return rows.where("kind = 'ref'").select("repo_id", "file_path", "name", "scope_id").distinct().join(i, ["repo_id", "file_path", "name"], "left_semi")


@query("n11_recorded_exports", f"WITH {CC}, i AS (SELECT DISTINCT repo_id, file_path, ord, unnest(flatten(map_values(imports))) AS name FROM cc), x AS (SELECT DISTINCT repo_id, file_path AS target, ord AS target_ord, unnest(span_ids) AS name FROM cc) SELECT i.repo_id, i.file_path, i.ord, i.name, target, target_ord FROM i JOIN x USING (repo_id, name) WHERE i.file_path <> target")
def n11(t):
    """Recorded imports with the chunks of their repository that hold a span of the name."""
    c = _cc(t)
    i = c.select("repo_id", "file_path", "ord", F.explode(F.flatten(F.map_values("imports"))).alias("name")).distinct()
    x = c.select("repo_id", F.col("file_path").alias("target"), F.col("ord").alias("target_ord"), F.explode("span_ids").alias("name")).distinct()
    return i.join(x, ["repo_id", "name"]).where("file_path <> target").select("repo_id", "file_path", "ord", "name", "target", "target_ord")


@query("n38_path_tree", f"""WITH {CC}, p AS (SELECT DISTINCT repo_id, string_split(replace(regexp_replace(file_path, '\\.py$', ''), '/', '.'), '.') AS parts FROM cc WHERE file_path LIKE '%.py'), x AS (SELECT repo_id, parts, unnest(range(1, len(parts) + 1)) AS n FROM p)
 SELECT repo_id, array_to_string(parts[1:n], '.') AS prefix, n AS depth, bool_or(n = len(parts)) AS show, count(DISTINCT parts[n + 1]) AS n_children FROM x GROUP BY 1, 2, 3""")
def n38(t):
    name = F.replace(F.regexp_replace("file_path", r"\.py$", ""), F.lit("/"), F.lit("."))
    return T.path_tree(_cc(t).where("file_path LIKE '%.py'").select("repo_id", name.alias("path")).distinct(), ["repo_id"])


@query("n39_file_imports")
def n39(t):
    """One row per imported name of a file, with what kind of module it comes from."""
    return N.classified_imports(_imports(t), SYSTEM, THIRD_PARTY).select("repo_id", "file_path", "name", "module", "import_kind", "target")


@query("h10_subtree_spans", "SELECT r_regionkey AS root, 'n' || n_nationkey AS node FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT r_regionkey, 's' || s_suppkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey UNION ALL SELECT r_regionkey, 'c' || c_custkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey")
def h10(t):
    """All that lies below the roots."""
    from .graph import _tree

    d = G.descendants(_tree(t), t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("root")))
    return d.select(F.substring("root", 2, 10).cast("int").alias("root"), "node")


@query("h11_blocks_by_path")
def h11(t):
    """Blocks whose dotted path is the name of a span of their file."""
    wanted = _cc(t).select("repo_id", "file_path", F.explode("span_ids").alias("path"))
    return T.by_path(B.blocks(_py(t)), wanted).select("repo_id", "file_path", "path", "type", "start_line", "end_line")


@query("h12_found_references")
def h12(t):
    """Where what blocks call, inherit from or are typed by is found."""
    tree = G.checkpointed(B.blocks(_py(t)))
    refs = tree.select("repo_id", "file_path", "block", F.explode("relationships").alias("r")).where("r.kind <> 'import'").select("repo_id", "file_path", "block", F.col("r.target").alias("ref"))
    return T.found_references(tree, refs)


@query("h2_cluster_driver")
def h2(t):
    """Communities of the import graph with their sizes; the largest is split by folder (H2)."""
    from .graph import _import_edges

    members = G.checkpointed(G.communities(_import_edges(t)))
    sizes = members.groupBy("community").agg(F.count("*").alias("n"))
    largest = sizes.orderBy(F.desc("n"), "community").limit(1).select("community", F.lit(True).alias("is_largest"))
    folder = F.regexp_extract(F.substring_index("node", ":", -1), "^([^/]*)", 1)
    x = members.join(F.broadcast(largest), "community", "left")
    x = x.select("node", F.when(F.col("is_largest"), F.concat_ws("/", "community", folder)).otherwise(F.col("community")).alias("cluster_id"))
    return x.groupBy("cluster_id").agg(F.count("*").alias("n_nodes"), F.min("node").alias("first_node"))


# ------------------------------------------------------------------------------------------- edits
_CH = "ch AS (SELECT n_regionkey AS parent, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS pos, CAST(n_nationkey AS VARCHAR) AS child FROM nation)"


def _children(t):
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    return t("nation").select(F.col("n_regionkey").alias("parent"), (F.row_number().over(w) - 1).alias("pos"), F.col("n_nationkey").cast("string").alias("child"))


@query("i16_edited_children", f"""WITH {_CH}, i AS (SELECT parent, CAST(pos AS DOUBLE) AS p, 1 AS old, child FROM ch UNION ALL SELECT r_regionkey, 1.0, 0, 'new' FROM region), a AS (SELECT parent, row_number() OVER (PARTITION BY parent ORDER BY p, old, child) - 1 AS pos, child FROM i),
 d AS (SELECT * FROM a WHERE NOT (parent = 0 AND child = '0')), e AS (SELECT parent, row_number() OVER (PARTITION BY parent ORDER BY pos) - 1 AS pos, child FROM d) SELECT parent, pos, CASE WHEN child = '1' THEN 'one' ELSE child END AS child FROM e""")
def i16(t):
    """A child put in at place 1 of every parent, one taken away, one replaced."""
    new = t("region").select(F.col("r_regionkey").alias("parent"), F.lit(1).alias("pos"), F.lit("new").alias("child"))
    gone = t("nation").where("n_nationkey = 0 AND n_regionkey = 0").select(F.col("n_regionkey").alias("parent"), F.col("n_nationkey").cast("string").alias("child"))
    swaps = t("nation").where("n_nationkey = 1").select(F.col("n_regionkey").alias("parent"), F.lit("1").alias("child"), F.lit("one").alias("new"))
    return T.replaced(T.removed(T.inserted(_children(t), new), gone), swaps)


@query("i16_indented", f"WITH {CC} SELECT repo_id, file_path, ord, regexp_replace(content, '(?m)^([^\\n]*\\S)', '    \\1', 'g') AS content FROM cc WHERE content IS NOT NULL AND NOT contains(content, chr(13))")
def i16b(t):
    return _cc(t).where(F.col("content").isNotNull() & ~F.contains("content", F.lit("\r"))).select("repo_id", "file_path", "ord", T.indented(F.col("content"), 4).alias("content"))


@query("i15_accepted_updates")
def i15(t):
    """Files whose second line is replaced, and whether the new text would be taken."""
    old = _py(t)
    return T.accepted_updates(old, old.select("repo_id", "file_path", P.replaced_lines(F.col("content"), 1, 2, ["x = 1"]).alias("content"))).select("repo_id", "file_path", "changed", "accepted", "reason")


@query("i21_context_rows", f"WITH {CC} SELECT DISTINCT repo_id, file_path, unnest(span_ids) AS span_id FROM cc")
def i21(t):
    """Spans of every file made rows with JSON, and back."""
    return D.context_spans(D.context_rows(_cc(t).select("repo_id", "file_path", F.explode("span_ids").alias("span_id"))))


@query("i22_replayed_context", f"WITH {TU} SELECT DISTINCT session_id, repo_id, chunk_id FROM tu WHERE chunk_id IS NOT NULL AND repo_id IS NOT NULL")
def i22(t):
    """The chunks that the calls of a session named, each once."""
    return M.latest_calls(t("token_usage")).where("chunk_id IS NOT NULL AND repo_id IS NOT NULL").select("session_id", "repo_id", "chunk_id").distinct()


# --------------------------------------------------------------------------------------- renderings
@query("j6_prompt_pieces", f"""WITH {CC}, s AS (SELECT *, sum(greatest(coalesce(tokens, 0), 0)) OVER (PARTITION BY repo_id, file_path ORDER BY ord) AS upto FROM cc), g AS (SELECT *, coalesce(start_line > lag(end_line) OVER (PARTITION BY repo_id, file_path ORDER BY ord) + 1, start_line > 1) AS gap FROM s WHERE upto <= 2000),
 l AS (SELECT repo_id, file_path, ord, gap, span_ids, start_line, string_split(coalesce(content, ''), chr(10)) AS ls FROM g)
 SELECT repo_id, file_path, ord, (CASE WHEN gap THEN '...' || chr(10) ELSE '' END) || '<span ids=''' || array_to_string(coalesce(span_ids, []), ',') || '''>' || chr(10) || array_to_string(list_transform(range(1, len(ls) + 1), lambda i: lpad(CAST(start_line + i - 1 AS VARCHAR), 6, ' ') || chr(9) || ls[i]), chr(10)) || chr(10) || '</span>' AS text FROM l""")
def j6(t):
    return D.prompt_pieces(_cc(t), 2000)


@query("j9_cluster_rows", "SELECT DISTINCT id, concat_ws(chr(10), repo_name, url) AS text, len(coalesce(cluster_files, [])) AS n_chunks, repo_name AS title, 'cluster' AS type FROM repos")
def j9(t):
    """Repositories as clusters: rows to index."""
    rows = D.index_rows(t("repos").select("id", F.col("repo_name").alias("title"), F.col("url").alias("summary"), F.col("cluster_files").alias("chunk_ids")))
    return rows.select("id", "text", F.size("chunk_ids").alias("n_chunks"), "title", "type").distinct()


@query("j12_cluster_files", f"SELECT DISTINCT label FROM (SELECT label FROM embeddings ORDER BY {_D0}, vec_id LIMIT 5)")
def j12(t):
    """The files alone of the nearest vectors."""
    return V.top_k(t("embeddings"), _q0(t), 5).select("label").distinct()


@query("j13_summaries", f"WITH {CC} SELECT repo_id, file_path, ord, string_split(content, chr(10))[1] AS summary FROM cc WHERE content IS NOT NULL")
def j13(t):
    """A summary per chunk by a function of texts; here it gives the first line."""
    rows = _cc(t).where("content IS NOT NULL").select("repo_id", "file_path", "ord", "content")
    return D.mapped(rows, "content", lambda texts: [x.split("\n", 1)[0] for x in texts], "summary").select("repo_id", "file_path", "ord", "summary")


# ------------------------------------------------------------------------------------------ metrics
@query("e22_status_histogram", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1")
def e22(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("e26_relevant_decisions", f"WITH {TU}, k AS (SELECT session_id, chunk_id FROM tu WHERE chunk_id IS NOT NULL) SELECT session_id, count(*) AS n_decisions, count(DISTINCT chunk_id) AS n_relevant, count(*) - count(DISTINCT chunk_id) AS n_again FROM k GROUP BY 1")
def e26(t):
    k = M.latest_calls(t("token_usage")).where("chunk_id IS NOT NULL")
    return k.groupBy("session_id").agg(F.count("*").alias("n_decisions"), F.count_distinct("chunk_id").alias("n_relevant"), (F.count("*") - F.count_distinct("chunk_id")).alias("n_again"))


@query("e28_invocations", f"WITH {TU} SELECT call_id, function_name, model, greatest(coalesce(prompt_tokens, 0), 0) + greatest(coalesce(completion_tokens, 0), 0) AS tokens FROM tu")
def e28(t):
    z = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    return M.latest_calls(t("token_usage")).select("call_id", "function_name", "model", (z("prompt_tokens") + z("completion_tokens")).alias("tokens"))


@query("g12_seeded_sample")
def g12(t):
    """Five chunks of every repository by a seeded hash: the sampling is the feature."""
    w = Window.partitionBy("repo_id").orderBy(F.xxhash64(F.lit(42), "file_path", "ord"), "file_path", "ord")
    return _cc(t).select("repo_id", "file_path", "ord").withColumn("place", F.row_number().over(w)).where("place <= 5")
