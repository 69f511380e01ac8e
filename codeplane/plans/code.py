"""Extraction, scopes, imports, chunk graphs and expressions bound to the chunks and their repositories."""

from __future__ import annotations

import sys

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import chunking as K
from ..operators.graphs import checkpointed
from ..operators import extract as B
from ..operators import scopes as N
from ..operators import search as R
from ..sources.chunks import clean_chunks, files
from .common import CC, EXT, FP
from .registry import query

#: Packages that others publish, by the names under which they are imported.
THIRD_PARTY = (
    "aiohttp attr bs4 boto3 celery click cryptography cv2 dateutil django dotenv fastapi flask google grpc httpx jinja2 jwt keras kubernetes lxml markdown matplotlib networkx nltk numpy openpyxl pandas PIL plotly psycopg2 "
    "pyarrow pydantic pymongo pyspark pytest redis regex requests rich ruamel scipy setuptools six sklearn spacy sqlalchemy starlette tensorflow tiktoken tokenizers torch tqdm transformers typer urllib3 uvicorn werkzeug wirepack yaml"
).split()
#: Modules that come with the language, as this interpreter lists them.
SYSTEM = sorted(sys.stdlib_module_names)


def _cc(t):
    return clean_chunks(t("chunks"))


def _py(t):
    return files(t("chunks"), ("py",))


def _caps(t):
    """Captures, written once where several steps read them."""
    return checkpointed(B.captures(_py(t)))


# ------------------------------------------------------------------------------------ extraction
@query("b1_blocks")
def b1(t):
    return B.blocks(_py(t)).select("repo_id", "file_path", "block", "parent", "type", "identifier", "path", "start_line", "end_line", "duplicate")


@query("b7_relationships")
def b7(t):
    return B.blocks(_py(t)).select("repo_id", "file_path", "path", F.explode("relationships").alias("r")).select("repo_id", "file_path", "path", "r.kind", "r.target")


@query("b8_parameters")
def b8(t):
    return B.blocks(_py(t)).where("type IN ('function', 'constructor')").select("repo_id", "file_path", "path", F.posexplode("params").alias("n", "param"))


def _tokenised(t):
    b = B.blocks(_py(t))
    lines = B.numbered_lines(_py(t)).select("repo_id", "file_path", "line_no", X.word_tokens(F.col("line")).alias("n"))
    w = Window.partitionBy("repo_id", "file_path").orderBy("line_no")
    sums = lines.select("repo_id", "file_path", "line_no", F.sum("n").over(w).alias("upto"), "n")
    a = sums.select("repo_id", "file_path", F.col("line_no").alias("start_line"), (F.col("upto") - F.col("n")).alias("before"))
    e = sums.select("repo_id", "file_path", F.col("line_no").alias("end_line"), F.col("upto").alias("after"))
    return b.join(a, ["repo_id", "file_path", "start_line"]).join(e, ["repo_id", "file_path", "end_line"]).withColumn("tokens", (F.col("after") - F.col("before")).cast("int"))


@query("b9_spans")
def b9(t):
    return K.spans(_tokenised(t).where("block > 0"))


@query("b11_token_counts", f"WITH {CC} SELECT repo_id, file_path, ord, len(regexp_extract_all(content, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]')) AS n FROM cc WHERE content IS NOT NULL")
def b11(t):
    return _cc(t).where("content IS NOT NULL").select("repo_id", "file_path", "ord", X.word_tokens(F.col("content")).alias("n"))


@query("b12_captures")
def b12(t):
    return B.captures(_py(t))


@query("b14_references")
def b14(t):
    return B.captures(_py(t)).where("kind = 'ref'").groupBy("repo_id", "file_path", "name").agg(F.count("*").alias("n"))


@query("b15_contexts")
def b15(t):
    return B.contexts(B.captures(_py(t)))


@query("b16_gaps", f"""WITH {CC}, g AS (SELECT repo_id, file_path, ord, start_line, max(end_line) OVER (PARTITION BY repo_id, file_path ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM cc WHERE len(map_keys(imports)) > 0)
 SELECT repo_id, file_path, last + 1 AS gap_start, start_line - 1 AS gap_end FROM g WHERE start_line > last + 1""")
def b16(t):
    """The lines between the chunks of a file that import something."""
    w = Window.partitionBy("repo_id", "file_path").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    g = _cc(t).where(F.size(F.map_keys("imports")) > 0).select("repo_id", "file_path", "start_line", F.max("end_line").over(w).alias("last"))
    return g.where("start_line > last + 1").select("repo_id", "file_path", (F.col("last") + 1).alias("gap_start"), (F.col("start_line") - 1).alias("gap_end"))


@query("b17_invocations")
def b17(t):
    return B.invocations(_py(t))


_LINES = f"{CC}, ff AS (SELECT repo_id, file_path, string_agg(content, chr(10) ORDER BY ord) AS content FROM cc GROUP BY 1, 2), ll AS (SELECT repo_id, file_path, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no, regexp_replace(unnest(string_split(content, chr(10))), '\\r$', '') AS line FROM ff"


@query("b18_hunks", f"""WITH {_LINES} WHERE content LIKE '%@@ -%'), f AS (SELECT *, last_value(coalesce(nullif(regexp_extract(line, '^diff --git a/(.+) b/.+', 1), ''), nullif(regexp_extract(line, '^--- a/(.+)', 1), '')) IGNORE NULLS) OVER w AS file
 FROM ll WINDOW w AS (PARTITION BY repo_id, file_path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 h AS (SELECT *, CAST(regexp_extract(line, '^@@ -(\\d+),(\\d+) \\+(\\d+),(\\d+) @@', 1) AS INT) AS a, CAST(regexp_extract(line, '^@@ -(\\d+),(\\d+) \\+(\\d+),(\\d+) @@', 2) AS INT) AS n FROM f WHERE file IS NOT NULL AND regexp_matches(line, '^@@ -(\\d+),(\\d+) \\+(\\d+),(\\d+) @@'))
 SELECT repo_id, file_path, file, a + greatest(1, least(3, a - 3)) AS start, a + greatest(1, least(3, a - 3)) + greatest(0, n - 7) AS end_ FROM h""")
def b18(t):
    p = files(t("chunks")).where("content LIKE '%@@ -%'")
    return B.hunks(p, ["repo_id", "file_path"]).select("repo_id", "file_path", "file", "start", F.col("end").alias("end_"))


@query("b20_log_errors", "SELECT doc_id, len(regexp_extract_all(text, '(?m)^\\s*at \\S+\\((\\S+):(\\d+)\\)', 1)) AS n FROM documents WHERE text LIKE '%  at %'")
def b20(t):
    return t("documents").where("text LIKE '%  at %'").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"(?m)^\s*at \S+\((\S+):(\d+)\)"), 1)).alias("n"))


@query("b22_grep", f"WITH {_LINES}) SELECT repo_id, file_path, line_no, line FROM ll WHERE contains(lower(line), 'import json') AND file_path LIKE '%.py'")
def b22(t):
    return B.grep(_py(t), "import json")


@query("b23_code_refs", "SELECT doc_id, unnest(regexp_extract_all(text, '`([a-z_]+)\\(\\)`', 1)) AS ref FROM documents")
def b23(t):
    return t("documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"`([a-z_]+)\(\)`"), 1)).alias("ref"))


@query("b24_clean_markdown", r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '(?m)^```(?:markdown|md)?\s*$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS text FROM documents")
def b24(t):
    return t("documents").select("doc_id", X.clean_markdown(F.col("text")).alias("text"))


@query("b27_repo_urls", "SELECT id, url, nullif(regexp_extract(url, '^(?:https?://[^/]+/|git@[^:]+:)([^/]+)/', 1), '') AS owner_, nullif(regexp_extract(url, '^(?:https?://[^/]+/|git@[^:]+:)[^/]+/([^/]+?)(?:\\.git)?/?$', 1), '') AS repo_, regexp_replace(url, '^https?://([^/]+)/', 'git@\\1:') AS ssh FROM repos")
def b27(t):
    u = F.col("url")
    return t("repos").select("id", "url", X.github_owner(u).alias("owner_"), X.github_repo(u).alias("repo_"), X.http_to_ssh(u).alias("ssh"))


@query("b28_snake_case", f"WITH {CC} SELECT DISTINCT file_name, lower(regexp_replace(regexp_replace(file_name, '\\.java$', ''), '(.)([A-Z])', '\\1_\\2', 'g')) AS table_name FROM cc WHERE file_name LIKE '%.java'")
def b28(t):
    return _cc(t).where("file_name LIKE '%.java'").select("file_name", X.snake_case(F.regexp_replace("file_name", r"\.java$", "")).alias("table_name")).distinct()


@query("b29_tree")
def b29(t):
    return B.tree_lines(_cc(t).select("repo_id", "file_path").distinct(), "repo_id")


# ----------------------------------------------------------------------------------- expressions
@query("c1_metadata", f"WITH {CC} SELECT repo_id, file_path, ord, list_extract(string_split(file_path, '/'), -1) AS base, CASE WHEN regexp_matches(file_path, '(^|/)tests?/.+|(^|/)test_[^/]*\\.py$|_test\\.py$') THEN 'test' ELSE 'implementation' END AS kind FROM cc")
def c1(t):
    return _cc(t).select("repo_id", "file_path", "ord", X.basename(F.col("file_path")).alias("base"), X.category(F.col("file_path")).alias("kind"))


@query("c2_node_filter", f"WITH {CC} SELECT repo_id, file_path, ord FROM cc WHERE category = 'test' AND tokens > 100 AND start_line < 50")
def c2(t):
    return _cc(t).where("category = 'test' AND tokens > 100 AND start_line < 50").select("repo_id", "file_path", "ord")


@query("c3_unique_node", f"WITH {CC} SELECT repo_id, chunk_id, CASE WHEN count(*) = 1 THEN min(file_path) END AS file_path, count(*) > 1 AS is_error FROM cc GROUP BY 1, 2")
def c3(t):
    """Lookups of every node by its id: its file, or an error where the id is not its own."""
    return R.unique(_cc(t), ["repo_id", "chunk_id"], "file_path")


@query("c4_exists", f"WITH {CC} SELECT repo_id, file_path, ord FROM cc WHERE EXISTS (SELECT 1 FROM token_usage u WHERE u.repo_id = cc.repo_id AND u.chunk_id = cc.chunk_id)")
def c4(t):
    u = t("token_usage").select("repo_id", "chunk_id").distinct()
    return _cc(t).join(u, ["repo_id", "chunk_id"], "left_semi").select("repo_id", "file_path", "ord")


_NEXT = f"{CC}, p AS (SELECT repo_id, file_path, ord, start_line AS a, end_line AS b, lead(start_line) OVER (PARTITION BY repo_id, file_path ORDER BY ord) AS c, lead(end_line) OVER (PARTITION BY repo_id, file_path ORDER BY ord) AS d FROM cc)"


@query("c5_line_predicates", f"WITH {_NEXT} SELECT repo_id, file_path, ord, a <= c AND d <= b AS contains_, (c BETWEEN a AND b) OR (d BETWEEN a AND b) AS one_sided, NOT (b < c OR a > d) AS shares, a >= c AND b <= d AS within_ FROM p WHERE c IS NOT NULL")
def c5(t):
    w = Window.partitionBy("repo_id", "file_path").orderBy("ord")
    p = _cc(t).select("repo_id", "file_path", "ord", F.col("start_line").alias("a"), F.col("end_line").alias("b"), F.lead("start_line").over(w).alias("c"), F.lead("end_line").over(w).alias("d")).where("c IS NOT NULL")
    r = [F.col(x) for x in "abcd"]
    return p.select("repo_id", "file_path", "ord", X.contains_lines(*r).alias("contains_"), X.overlaps_one_sided(*r).alias("one_sided"), X.overlaps_lines(*r).alias("shares"), X.within_lines(*r).alias("within_"))


@query("c9_content_match", f"WITH {CC} SELECT repo_id, s AS span_id, bool_or(contains(content, 'logger')) AS hit FROM (SELECT repo_id, content, unnest(span_ids) AS s FROM cc) GROUP BY 1, 2")
def c9(t):
    return _cc(t).select("repo_id", "content", F.explode("span_ids").alias("span_id")).groupBy("repo_id", "span_id").agg(F.bool_or(F.contains("content", F.lit("logger"))).alias("hit"))


@query("c10_unspaced", f"WITH {CC} SELECT repo_id, file_path, ord FROM cc WHERE contains(translate(content, ' ' || chr(9) || chr(10) || chr(13), ''), 'returnNone')")
def c10(t):
    return _cc(t).where(X.contains_unspaced(F.col("content"), F.lit("return None"))).select("repo_id", "file_path", "ord")


@query("c11_ignorable_comments", f"WITH {_LINES}), m AS (SELECT repo_id, file_path, line_no, regexp_extract(line, '^\\s*#+\\s?(.*)$', 1) AS c FROM ll WHERE regexp_matches(line, '^\\s*#') AND file_path LIKE '%.py') SELECT repo_id, file_path, line_no FROM m WHERE length(trim(c)) = 0 OR regexp_matches(c, '(?i)copyright|license|author')")
def c11(t):
    m = B.numbered_lines(_py(t)).where(F.col("line").rlike(r"^\s*#")).select("repo_id", "file_path", "line_no", F.regexp_extract("line", r"^\s*#+\s?(.*)$", 1).alias("c"))
    return m.where(X.ignorable_comment(F.col("c"))).select("repo_id", "file_path", "line_no")


@query("c12_generated_large", f"WITH {CC}, f AS (SELECT repo_id, file_path, tokens, first_value(content) OVER (PARTITION BY repo_id, file_path ORDER BY ord) AS fc FROM cc), g AS (SELECT repo_id, file_path, min(fc) AS fc, sum(tokens) AS tokens FROM f GROUP BY 1, 2) SELECT repo_id, file_path, tokens FROM g WHERE tokens > 2000 AND regexp_matches(lower(split_part(fc, chr(10), 1)), '^\\s*(#|//|/\\*).*generated')")
def c12(t):
    return K.generated_over_limit(_cc(t))


@query("c13_excluded", f"WITH {CC} SELECT DISTINCT repo_id, file_path FROM cc WHERE NOT (regexp_matches(file_path, '^.*/tests/.*$') OR regexp_matches(list_extract(string_split(file_path, '/'), -1), '^test_.*\\.py$'))")
def c13(t):
    return _cc(t).where(~X.excluded(F.col("file_path"), ["*/tests/*", "test_*.py"])).select("repo_id", "file_path").distinct()


@query("c15_glob_or_deep", f"WITH {CC} SELECT DISTINCT repo_id, file_path FROM cc WHERE regexp_matches(file_path, '(^|/)cache\\.py$')")
def c15(t):
    f = _cc(t).select("repo_id", "file_path").distinct()
    return R.found_or(f.where(X.matches_any(F.col("file_path"), ["cache.py"])), f.where(X.matches_any(F.col("file_path"), ["**/cache.py"])))


@query("c17_test_patterns", f"WITH {CC} SELECT DISTINCT file_name FROM cc WHERE file_name LIKE 'test\\_%' ESCAPE '\\' OR contains(file_name, '/test') OR regexp_matches(file_name, '^tests?/|_test\\.')")
def c17(t):
    return _cc(t).where(X.is_test_pattern(F.col("file_name"))).select("file_name").distinct()


@query("c21_import_blocks", f"WITH {CC} SELECT repo_id, file_path, ord FROM cc WHERE len(string_split(lower(content), 'import')) - 1 > 3")
def c21(t):
    return _cc(t).where(X.is_import_block(F.col("content"))).select("repo_id", "file_path", "ord")


@query("c23_parents_only", "SELECT r_regionkey FROM region SEMI JOIN nation ON r_regionkey = n_regionkey")
def c23(t):
    return t("region").join(t("nation").select(F.col("n_regionkey").alias("r_regionkey")), "r_regionkey", "left_semi").select("r_regionkey")


@query("c25_served_files", f"WITH {CC}, k AS (SELECT DISTINCT id AS repo_id, string_split(unnest(cluster_files), '/')[-1] AS tail FROM repos) SELECT DISTINCT repo_id, file_path FROM cc WHERE (repo_id, string_split(file_path, '/')[-1]) IN (SELECT repo_id, tail FROM k)")
def c25(t):
    """Files whose name is that of one of their repository's cluster files."""
    k = t("repos").select(F.col("id").alias("repo_id"), F.explode("cluster_files").alias("f")).select("repo_id", X.basename(F.col("f")).alias("tail")).distinct()
    return _cc(t).select("repo_id", "file_path", X.basename(F.col("file_path")).alias("tail")).join(k, ["repo_id", "tail"], "left_semi").select("repo_id", "file_path").distinct()


@query("c27_nested_default", f"WITH {CC} SELECT repo_id, file_path, ord, coalesce(summary.short_description, 'none') AS short FROM cc")
def c27(t):
    return _cc(t).select("repo_id", "file_path", "ord", F.coalesce("summary.short_description", F.lit("none")).alias("short"))


@query("c30_namespaces", f"WITH {CC}, m AS (SELECT DISTINCT replace(replace(file_path, '/', '.'), '.py', '') AS name FROM cc WHERE file_path LIKE '%.py') SELECT name, string_split(name, '.')[1] AS root, string_split(name, '.')[-1] AS leaf FROM m")
def c30(t):
    m = _cc(t).where("file_path LIKE '%.py'").select(F.replace(F.replace("file_path", F.lit("/"), F.lit(".")), F.lit(".py"), F.lit("")).alias("name")).distinct()
    n = X.namespace(F.col("name"))
    return m.select("name", n["root"].alias("root"), n["leaf"].alias("leaf"))


@query("c35_path_prefix", f"WITH {CC} SELECT repo_id, file_path, ord FROM cc WHERE list_slice(string_split(file_path, '/'), 1, 1) = ['src']")
def c35(t):
    return _cc(t).where(F.slice(F.split("file_path", "/"), 1, 1) == F.array(F.lit("src"))).select("repo_id", "file_path", "ord")


@query("c36_posix", f"SELECT file_path AS raw, {FP} AS clean, count(*) AS n FROM chunks WHERE file_path IS NOT NULL GROUP BY 1, 2")
def c36(t):
    return t("chunks").where("file_path IS NOT NULL").groupBy(F.col("file_path").alias("raw"), X.clean_path(F.col("file_path")).alias("clean")).agg(F.count("*").alias("n"))


@query("c38_parser_dispatch", f"WITH {CC} SELECT CASE WHEN file_path LIKE '%.py' THEN 'python' WHEN file_path LIKE '%.java' THEN 'java' END AS parser, count(*) AS n FROM cc GROUP BY 1")
def c38(t):
    return _cc(t).groupBy(X.parser_of(F.col("file_path")).alias("parser")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------------------ scopes and imports
_SC = f"{CC}, sc AS (SELECT repo_id, file_path, ord AS scope_id, start_line AS start_row, end_line AS end_row FROM cc UNION ALL SELECT repo_id, file_path, 1000 + min(ord), min(start_line), max(end_line) FROM cc GROUP BY 1, 2), rg AS (SELECT repo_id, file_path, ord, start_line + 1 AS s, start_line + 3 AS e FROM cc)"


@query("n1_smallest_enclosing", f"""WITH {_SC}, h AS (SELECT rg.repo_id, rg.file_path, rg.ord, scope_id, row_number() OVER (PARTITION BY rg.repo_id, rg.file_path, rg.ord ORDER BY end_row - start_row, scope_id) AS n FROM rg JOIN sc USING (repo_id, file_path) WHERE start_row <= s AND e <= end_row)
 SELECT rg.repo_id, rg.file_path, rg.ord, coalesce(h.scope_id, 0) AS scope_id FROM rg LEFT JOIN (SELECT * FROM h WHERE n = 1) h USING (repo_id, file_path, ord)""")
def n1(t):
    c = _cc(t)
    sc = c.select("repo_id", "file_path", F.col("ord").alias("scope_id"), F.col("start_line").alias("start_row"), F.col("end_line").alias("end_row")).unionAll(c.groupBy("repo_id", "file_path").agg((F.min("ord") + 1000).alias("scope_id"), F.min("start_line").alias("start_row"), F.max("end_line").alias("end_row")))
    r = c.select("repo_id", "file_path", "ord", (F.col("start_line") + 1).alias("s"), (F.col("start_line") + 3).alias("e"))
    return N.smallest_enclosing(r, sc).select("repo_id", "file_path", "ord", "scope_id")


@query("n2_scope_tree")
def n2(t):
    return N.scope_table(_caps(t))


def _placed(t):
    caps = _caps(t)
    return N.placed(caps, N.scope_table(caps))


@query("n3_placed")
def n3(t):
    return _placed(t)


@query("n4_resolved_refs")
def n4(t):
    return N.resolved_refs(_placed(t))


@query("n5_call_refs")
def n5(t):
    return N.call_refs(_caps(t))


def _imports(t, caps=None):
    i = (caps if caps is not None else _caps(t)).where("kind = 'import'").select("repo_id", "file_path", "name", F.regexp_replace("sub", r"^\.+", "").alias("module"))
    return N.module_files(i, _cc(t).select("repo_id", "file_path").distinct()).withColumn("root", F.element_at(F.split("module", r"\."), 1))


@query("n7_module_files")
def n7(t):
    return _imports(t).select("repo_id", "file_path", "name", "module", "target")


@query("n8_classified_imports")
def n8(t):
    return N.classified_imports(_imports(t), SYSTEM, THIRD_PARTY).groupBy("repo_id", "import_kind").agg(F.count("*").alias("n"))


@query("n10_exports")
def n10(t):
    return N.exports(_placed(t))


def _local(t):
    """Captures, scopes, placed names, imports and exports from one reading of the files."""
    caps = _caps(t)
    scopes = checkpointed(N.scope_table(caps))
    rows = checkpointed(N.placed(caps, scopes))
    return caps, scopes, rows, _imports(t, caps), N.exports(rows)


@query("n11_import_exports")
def n11(t):
    *_, imports, exported = _local(t)
    return N.import_exports(imports, exported)


@query("n12_repo_edges")
def n12(t):
    _, _, rows, imports, exported = _local(t)
    return N.repo_edges(rows, imports, exported)


@query("n14_chunk_edges")
def n14(t):
    caps, scopes, rows, imports, exported = _local(t)
    return N.chunk_edges(N.repo_edges(rows, imports, exported), _cc(t), scopes, caps)


_NE = f"{CC}, r AS (SELECT repo_id, concat(repo_id, ':', file_path, ':', ord) AS chunk, name, min(n) AS o FROM (SELECT repo_id, file_path, ord, unnest(flatten(map_values(imports))) AS name, unnest(range(len(flatten(map_values(imports))))) AS n FROM cc) GROUP BY 1, 2, 3), d AS (SELECT DISTINCT repo_id, concat(repo_id, ':', file_path, ':', ord) AS chunk, unnest(span_ids) AS name FROM cc), j AS (SELECT r.repo_id, r.chunk AS src, d.chunk AS dst, r.name, r.o FROM r JOIN d USING (repo_id, name) WHERE r.chunk <> d.chunk)"


def _name_tables(t):
    key = F.concat_ws(":", "repo_id", "file_path", "ord").alias("chunk")
    c = _cc(t)
    r = c.where("imports IS NOT NULL").select("repo_id", key, F.posexplode(F.flatten(F.map_values("imports"))).alias("ord_", "name")).withColumnRenamed("ord_", "ord")
    return r, c.select("repo_id", key, F.explode("span_ids").alias("name"))


@query("n15_name_edges", f"WITH {_NE} SELECT repo_id, src, dst, name FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY o, name) AS n FROM j) WHERE n = 1")
def n15(t):
    return N.name_edges(*_name_tables(t), ["repo_id"])


@query("n16_cluster_edges", f"WITH {_NE}, m AS (SELECT concat(repo_id, ':', file_path, ':', ord) AS chunk, concat(repo_id, ':', regexp_extract(file_path, '^(.*)/', 1)) AS cluster FROM cc), p AS (SELECT DISTINCT src, dst FROM j) SELECT a.cluster AS src_cluster, b.cluster AS dst_cluster, count(*) AS n_edges FROM p JOIN m a ON a.chunk = src JOIN m b ON b.chunk = dst WHERE a.cluster <> b.cluster GROUP BY 1, 2")
def n16(t):
    e = N.name_edges(*_name_tables(t), ["repo_id"])
    m = _cc(t).select(F.concat_ws(":", "repo_id", "file_path", "ord").alias("chunk"), F.concat_ws(":", "repo_id", F.regexp_extract("file_path", "^(.*)/", 1)).alias("cluster"))
    return N.lifted(e, m)


@query("n17_merged_imports", f"WITH {CC}, x AS (SELECT repo_id, unnest(map_entries(imports)) AS e FROM cc), y AS (SELECT repo_id, e.key AS source, unnest(e.value) AS name FROM x) SELECT repo_id, source, list_sort(list(DISTINCT name)) AS names FROM y GROUP BY 1, 2")
def n17(t):
    return N.merged_imports(_cc(t), "repo_id")


@query("n18_adjacency", f"WITH {CC}, x AS (SELECT repo_id, chunk_id AS src, unnest(map_keys(imports)) AS dst FROM cc) SELECT repo_id, src, count(*) AS n_children, count(DISTINCT dst) AS n_distinct FROM x GROUP BY 1, 2")
def n18(t):
    return _cc(t).select("repo_id", F.col("chunk_id").alias("src"), F.explode(F.map_keys("imports")).alias("dst")).groupBy("repo_id", "src").agg(F.count("*").alias("n_children"), F.count_distinct("dst").alias("n_distinct"))


@query("n19_ref_counts", f"WITH {CC}, y AS (SELECT repo_id, unnest(flatten(map_values(imports))) AS name FROM cc) SELECT repo_id, name, count(*) AS n FROM y GROUP BY 1, 2")
def n19(t):
    return N.ref_counts(_cc(t), "repo_id")


@query("n30_find_by_name")
def n30(t):
    """Functions of every name that chunks of their repository import."""
    names = _cc(t).where("imports IS NOT NULL").select("repo_id", F.explode(F.flatten(F.map_values("imports"))).alias("identifier")).distinct()
    return R.find_by_names(B.blocks(_py(t)), names, "function").select("repo_id", "file_path", "path", "start_line")


@query("j8_name_index")
def j8(t):
    return R.name_index(B.blocks(_py(t)))


@query("j1_chunked")
def j1(t):
    return K.chunked(_tokenised(t))


@query("j4_chunk_records", f"WITH {CC} SELECT repo_id, file_path, min(start_line) AS start_line, max(end_line) AS end_line, sum(tokens) AS tokens, count(*) AS n FROM cc GROUP BY 1, 2")
def j4(t):
    return _cc(t).groupBy("repo_id", "file_path").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))


@query("j5_valid_chunks", f"WITH {CC} SELECT repo_id, file_path, ord, replace(content, chr(13) || chr(10), chr(10)) AS content FROM cc WHERE start_line IS NOT NULL AND end_line IS NOT NULL AND len(span_ids) > 0")
def j5(t):
    return K.valid_chunks(_cc(t)).select("repo_id", "file_path", "ord", "content")


@query("j7_display_text", f"WITH {CC} SELECT repo_id, file_path, ord, concat_ws(chr(10), 'File: ' || file_path, 'Lines: ' || start_line || '-' || end_line, content) AS text FROM cc")
def j7(t):
    return _cc(t).select("repo_id", "file_path", "ord", F.concat_ws("\n", F.concat(F.lit("File: "), "file_path"), F.concat(F.lit("Lines: "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")), "content").alias("text"))


@query("j14_repo_text", f"WITH {CC} SELECT repo_id, length(string_agg(coalesce(content, ''), chr(10) ORDER BY file_path, ord)) AS n_chars FROM cc GROUP BY 1")
def j14(t):
    parts = K.concatenated(_cc(t), ["repo_id"], ["file_path", "ord"])
    return parts.groupBy("repo_id").agg((F.sum(F.length("text")) + F.count("*") - 1).alias("n_chars"))


@query("j16_json_codec", f"WITH {CC} SELECT repo_id, file_path, ord, start_line, tokens FROM cc")
def j16(t):
    c = _cc(t).select("repo_id", "file_path", "ord", F.to_json(F.struct("start_line", "tokens")).alias("meta"))
    return c.select("repo_id", "file_path", "ord", F.from_json("meta", "start_line INT, tokens INT").alias("m")).select("repo_id", "file_path", "ord", "m.start_line", "m.tokens")


@query("j17_cluster_text", f"WITH {CC} SELECT repo_id, length(string_agg(chunk_id, chr(10) ORDER BY file_path, ord)) AS n_chars FROM cc GROUP BY 1")
def j17(t):
    parts = K.concatenated(_cc(t), ["repo_id"], ["file_path", "ord"], "chunk_id")
    return parts.groupBy("repo_id").agg((F.sum(F.length("text")) + F.count("*") - 1).alias("n_chars"))


_G10 = f"""{CC}, s AS (SELECT repo_id, file_path, ord AS span_id, greatest(coalesce(tokens, 0), 0) AS tokens, coalesce(len(map_keys(imports)) > 0, false) AS inside FROM cc),
 r AS (SELECT c.repo_id, c.file_path, s.span_id, s.tokens, c.tokens AS of_, row_number() OVER (PARTITION BY c.repo_id, c.file_path, s.span_id ORDER BY c.tokens DESC, c.span_id) AS n, c.span_id AS via FROM s c JOIN s USING (repo_id, file_path) WHERE c.inside AND NOT s.inside AND abs(s.span_id - c.span_id) = 1),
 z AS (SELECT repo_id, file_path, sum(tokens) AS size0 FROM s WHERE inside GROUP BY 1, 2),
 q AS (SELECT r.*, size0, coalesce(sum(r.tokens) OVER (PARTITION BY repo_id, file_path ORDER BY of_ DESC, via, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS added FROM r JOIN z USING (repo_id, file_path) WHERE n = 1 AND size0 <= 600),
 k AS (SELECT *, min(CASE WHEN greatest(tokens, of_) + size0 + added <= 600 THEN 1 ELSE 0 END) OVER (PARTITION BY repo_id, file_path ORDER BY of_ DESC, via, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fits FROM q)"""


@query("g10_expanded_context", f"WITH {_G10} SELECT repo_id, file_path, span_id, tokens FROM k WHERE fits = 1")
def g10(t):
    """Neighbours that chunks with imports draw into the context of their file, up to 600 tokens in all."""
    s = _cc(t).select("repo_id", "file_path", F.col("ord").alias("span_id"), F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).alias("tokens"), (F.size(F.map_keys("imports")) > 0).alias("inside"))
    near = s.select("repo_id", "file_path", "span_id", F.explode(F.array(F.col("span_id") - 1, F.col("span_id") + 1)).alias("related"))
    return K.expanded_context(s.where("inside").drop("inside"), near, s.drop("inside"), 600, ["repo_id", "file_path"])


@query("g11_small_classes", f"WITH {CC} SELECT repo_id, file_path FROM cc GROUP BY 1, 2 HAVING count(*) = 1")
def g11(t):
    return _cc(t).groupBy("repo_id", "file_path").agg(F.count("*").alias("n")).where("n = 1").select("repo_id", "file_path")
