"""Small fixtures with results worked out by hand, and invariants."""

import ast

import pytest
from pyspark.sql import functions as F

from codeplane.functions import exprs as X
from codeplane.operators import chunking, extract, graphs, metrics, ordered, scopes, search, sets, vectors
from codeplane.sources import io
from codeplane.streaming import ingest, windows


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_scope_parents(spark):
    caps = spark.createDataFrame([(1, "f", i, "scope", "function", f"s{i}", s, e, 0) for i, s, e in [(1, 1, 5), (2, 2, 4), (3, 3, 4), (4, 1, 4)]], "repo_id INT, file_path STRING, ord INT, kind STRING, sub STRING, name STRING, start_row INT, end_row INT, start_col INT")
    assert {r.scope_id: r.parent_id for r in scopes.scope_table(caps).collect()} == {1: 0, 2: 1, 3: 2, 4: 1}


def test_definitions_are_placed_and_references_resolved(spark):
    text = "import a\nh = 1\ndef func1(x):\n    return a.b(x) + missing\nclass A:\n    def m(self):\n        return func1(self)\n"
    files = spark.createDataFrame([(1, "f.py", text), (1, "bad.py", "def (")], "repo_id INT, file_path STRING, content STRING")
    caps = extract.captures(files)
    placed = scopes.placed(caps, scopes.scope_table(caps))
    assert {r.name for r in scopes.exports(placed).collect()} == {"func1", "A"}
    refs = {r.name: (r.def_ord is not None, r.import_ord is not None) for r in scopes.resolved_refs(placed).collect()}
    assert refs["a"] == (False, True) and refs["func1"] == (True, False) and "missing" not in refs
    assert {r.name: r.ref is not None for r in scopes.call_refs(caps).collect()} == {"b": False, "func1": True}


def test_repository_edges(spark):
    files = spark.createDataFrame([(1, "p/f1.py", "from f2 import a, b\ndef use():\n    return a() + b\n"), (1, "p/f2.py", "def a():\n    return 1\nb = 2\n")], "repo_id INT, file_path STRING, content STRING")
    caps = extract.captures(files)
    sc = scopes.scope_table(caps)
    placed = scopes.placed(caps, sc)
    imports = scopes.module_files(caps.where("kind = 'import'").select("repo_id", "file_path", "name", F.col("sub").alias("module")), files)
    edges = scopes.repo_edges(placed, imports, scopes.exports(placed))
    assert [(r.file_path, r.target, r.name) for r in edges.collect()] == [("p/f1.py", "p/f2.py", "a")]
    chunks = spark.createDataFrame([(1, "p/f1.py", 1, 1, 1), (1, "p/f1.py", 2, 2, 3), (1, "p/f2.py", 1, 1, 3)], "repo_id INT, file_path STRING, ord INT, start_line INT, end_line INT")
    assert [(r.src_ord, r.dst_ord) for r in scopes.chunk_edges(edges, chunks, sc, caps).collect()] == [(2, 1)]


def test_blocks_number_repeated_names(spark):
    b = extract.blocks(spark.createDataFrame([(1, "f.py", "def a(): pass\ndef a(): pass\nclass B:\n    def __init__(self, x: int): pass\n")], "repo_id INT, file_path STRING, content STRING"))
    got = [(r.type, r.path, r.duplicate) for r in b.orderBy("block").collect() if r.type != "statement"]
    assert got == [("module", "", 0), ("function", "a", 0), ("function", "a_1", 1), ("class", "B", 0), ("constructor", "B.__init__", 0)]


def test_hunks(spark):
    patch = "--- a/x.py\n+++ b/x.py\n@@ -10,8 +10,9 @@\n c\n--- a/y.py\n+++ b/y.py\n@@ -1,7 +1,8 @@\n@@ -5 +5 @@\n"
    assert rows(extract.hunks(spark.createDataFrame([(1, patch)], "id INT, content STRING"), ["id"]).select("file", "start", "end")) == [("x.py", 13, 14), ("y.py", 2, 2)]


def test_conflicts_collide(spark):
    ops = spark.createDataFrame([(1, "MoveOp", 1, "x"), (2, "MoveOp", 1, "x"), (3, "MoveOp", 2, "y"), (4, "AdoptCluster", None, None)], "seq INT, op_type STRING, src INT, chunk STRING")
    assert [r.seq for r in sets.conflict_free(ops, ["src", "chunk"]).orderBy("seq").collect()] == [3, 4]


def test_nearest(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 4.0]), (4, None)], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    assert [r.distance for r in vectors.top_k(v.where("embedding IS NOT NULL"), [0.0, 0.0], 3).collect()] == [1.0, 4.0, 25.0]
    q = spark.createDataFrame([(9, [0.0, 0.0])], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    assert [(r.vec_id, r.rank) for r in vectors.knn(v, q, 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert vectors.knn(v.limit(0), q, 2).count() == 0 and vectors.knn(v, q.limit(0), 2).count() == 0


def test_closeness(spark):
    m = spark.createDataFrame([(1, p, i, i * 400, 400) for p, i in enumerate([0, 1, 5, 4])], "cluster_id INT, pos INT, idx INT, before BIGINT, bytes BIGINT")
    assert ordered.closeness_chunks(m).first().closeness == pytest.approx(2 / 3)
    assert ordered.closeness_bytes(m).first().closeness == pytest.approx(1 / 4)
    assert [r.step for r in ordered.byte_steps(m).orderBy("pos").collect()] == [400, 1600, 400]


def test_budget(spark):
    s = spark.createDataFrame([(1, 0, 300), (1, 1, 300)], "g INT, rank INT, tokens INT")
    assert [r.given for r in ordered.ranked_budget(s, ["g"], 200).orderBy("rank").collect()] == [101, 98]
    assert [r.given for r in ordered.ranked_budget(s, ["g"], 700).orderBy("rank").collect()] == [300, 300]


def test_recall_and_perplexity(spark):
    r = spark.range(1).select(metrics.recall(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"), F.lit("b"))).alias("x")).first().x
    assert r == 0.5
    lp = spark.createDataFrame([(1, -1.0), (1, -2.0)], "g INT, lp DOUBLE")
    assert metrics.perplexity(lp, "g", "lp").first().perplexity == pytest.approx(4.4816890703)


def test_span_perplexity(spark):
    lp = spark.createDataFrame([(1, 0, "ab", -1.0), (1, 1, "cd", -2.0), (1, 2, "e", -3.0)], "call_id INT, pos INT, token STRING, logprob DOUBLE")
    s = spark.createDataFrame([(1, 3, 4)], "call_id INT, start INT, end INT")
    assert metrics.span_perplexity(lp, s).first().perplexity == pytest.approx(2.718281828**2)


def test_sessions_that_cost_nothing(spark):
    usage = [(1, "free", "embed", None, 0, 360), (2, "free", "embed", 0, 90, 7), (3, "unknown", "other", 10, 0, 5), (4, "no model", None, 10, 0, 5), (5, "paid", "embed", None, 0, 8), (6, "paid", "chat", 8, 4, 2), (7, "unpriced", "half", 4, 4, 1), (8, "odd", "embed", 0, -2, 1)]
    prices = [("embed", 0.5, 0.25, 0.0), ("chat", 2.0, 1.0, 4.0), ("half", 2.0, 1.0, None)]
    calls = spark.createDataFrame(usage, "call_id INT, session_id STRING, model STRING, prompt_tokens INT, cached_tokens INT, completion_tokens INT").withColumn("latency_ms", F.lit(1.0))
    costs = metrics.call_costs(calls, spark.createDataFrame(prices, "model STRING, prompt DOUBLE, cached DOUBLE, completion DOUBLE"))
    got = {r.session_id: (r.n_calls, r.cost, r.saved, str(r.saved_percent)) for r in metrics.cost_by(costs, "session_id").collect()}
    assert got == {
        "free": (2, 0.0, 0.0, "nan"), "unknown": (1, None, None, "None"), "no model": (1, None, None, "None"), "paid": (2, 20.0, 4.0, str(100 * 4.0 / 24.0)),
        "unpriced": (1, None, 4.0, "None"), "odd": (1, 0.5, -0.5, "-inf"),
    }


def test_agreement_of_a_labelling_with_itself(spark):
    d = spark.createDataFrame([(i % 3, i % 3) for i in range(30)], "a INT, b INT")
    assert [round(x, 9) for x in metrics.agreement(d, "a", "b").first()] == [1, 1, 1]


def test_communities_find_planted_groups(spark):
    edges = [(f"{g}{i}", f"{g}{j}") for g in "abc" for i in range(6) for j in range(6) if i < j] + [("a0", "b0"), ("b1", "c1")]
    e = spark.createDataFrame(edges, "src STRING, dst STRING")
    labels = graphs.communities(e)
    got = {}
    for r in labels.collect():
        got.setdefault(r.community, set()).add(r.node[0])
    assert len(got) == 3 and all(len(s) == 1 for s in got.values())
    one = labels.withColumn("community", F.lit("x"))
    assert graphs.codelength(e, labels).first().codelength < graphs.codelength(e, one).first().codelength


def test_simple_paths_and_series(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 4)], "src INT, dst INT")
    p = graphs.simple_paths(e, 5).collect()
    assert sorted(r.path for r in p) == [[1, 2], [1, 2, 3], [1, 2, 4], [2, 3], [2, 4], [3, 1, 2, 4]]
    assert all(len(set(r.path)) == len(r.path) for r in p)
    s = graphs.edge_series(e.withColumn("g", F.lit(1)), "g").collect()
    assert sorted((a, b) for r in s for a, b in zip(r.chain, r.chain[1:])) == [(1, 2), (2, 3), (2, 4), (3, 1)]


def test_balanced_groups(spark):
    d = spark.createDataFrame([("a", 5), ("b", 4), ("c", 3), ("d", 3), ("e", 1)], "id STRING, size INT")
    assert {r.id: r.group for r in sets.balanced_groups(d).collect()} == {"a": 0, "b": 1, "c": 2, "d": 2, "e": 1}


def test_merge_small():
    assert chunking.merge_small([50, 500, 60, 700]) == [(0, 2), (3, 3)]
    assert chunking.merge_small([10, 2000, 10], hard=2000) == [(0, 0), (1, 1), (2, 2)]
    assert chunking.merge_small([500] * 5, most=3) == [(0, 1), (2, 3), (4, 4)]


def test_chunks_cover_their_blocks(spark):
    text = "import os\n" + "".join(f"def f{i}(a, b):\n    x = a + b\n    return x * {i}\n\n" for i in range(40))
    tree = ast.parse(text)
    blocks = [{"block": 0, "parent": -1, "start_line": 1, "end_line": 161, "tokens": 800}] + [{"block": i + 1, "parent": 0, "start_line": n.lineno, "end_line": n.end_lineno, "tokens": 20} for i, n in enumerate(tree.body)]
    got = chunking.bounded_chunks(blocks, soft=200, least=50)
    assert all(n <= 220 for _, _, n in got) and got[0][0] == 1 and [b[0] > a[1] for a, b in zip(got, got[1:])] == [True] * (len(got) - 1)


def test_exact_hits_reset(spark):
    h = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 3, False)], "g INT, id INT, exact BOOLEAN")
    assert [r.id for r in ordered.exact_only(h, ["g"], "exact").orderBy("id").collect()] == [1, 3]


def test_overlapping_lines_are_removed(spark):
    a = F.array(*[F.lit(x) for x in "abc"])
    b = F.array(*[F.lit(x) for x in "bcd"])
    assert spark.range(1).select(ordered.without_repeated_lines(a, b).alias("x")).first().x == ["a"]


def test_expressions(spark):
    d = spark.createDataFrame([("./a\\b/test_x.py", "https://git.example/own/my-repo.git", "CamelCaseName", "x ```yaml\na: 1\n``` y", "<t>1</t> <t>2</t>", "[[a::1]]")], "p STRING, u STRING, n STRING, f STRING, t STRING, r STRING")
    r = d.select(
        X.clean_path(F.col("p")), X.category(X.clean_path(F.col("p"))), X.github_owner(F.col("u")), X.github_repo(F.col("u")), X.http_to_ssh(F.col("u")), X.snake_case(F.col("n")), F.trim(X.fenced(F.col("f"), "yaml"), F.lit("\n")), X.between_tags(F.col("t"), "t"), X.double_bracket_refs(F.col("r")),
        X.contains_unspaced(F.lit("a  b\nc"), F.lit("b c")), X.is_placeholder_comment(F.lit("# ... rest")), X.lines(F.lit("a\nb\nc"), 1, 3),
    ).first()
    assert list(r) == ["a/b/test_x.py", "test", "own", "my-repo", "git@git.example:own/my-repo.git", "camel_case_name", "a: 1", ["1", "2"], ["a::1"], True, True, "b\nc"]
    assert [bool(__import__("re").match(X.glob_regex("**/tests/**"), p)) for p in ("tests/a.py", "x/tests/y/z.py", "x/test/y")] == [True, True, False]


def test_search_fallbacks(spark):
    b = spark.createDataFrame([(1, "src/a.py", "function", "f", "f"), (1, "tests/t.py", "function", "f", "f"), (1, "lib/b.py", "function", "f", "C.f")], "repo_id INT, file_path STRING, type STRING, identifier STRING, path STRING")
    assert [r.file_path for r in search.find_by_name(b, ["f"], "function", "src/*.py").collect()] == ["src/a.py"]
    assert len(search.find_by_name(b, ["f"], "function", "none/*.py").collect()) == 2
    assert [r.file_path for r in search.find_by_name(b, ["f"], "function", within="C").collect()] == ["lib/b.py"]
    assert search.partial_ratio("abc", "xxabcxx") == 100.0 and search.partial_ratio("", "a") == 0.0
    assert search.found_or(b.where("file_path = 'x'"), b.where("type = 'function'")).count() == 3


def test_sources(spark, tmp_path):
    (tmp_path / "repo/tests").mkdir(parents=True)
    (tmp_path / "repo/a.py").write_text("x = 1\n")
    (tmp_path / "repo/tests/test_a.py").write_text("y = 2\n")
    (tmp_path / "repo/bad.py").write_bytes(b"\xff\xfe\x00")
    got = io.scan_repository(spark, str(tmp_path / "repo"), exclude=["skip*"])
    assert rows(got.select("file_path", "category")) == [("a.py", "implementation"), ("tests/test_a.py", "test")]
    nodes, edges = spark.createDataFrame([(1, "a")], "id INT, kind STRING"), spark.createDataFrame([(1, 1)], "source INT, target INT")
    io.write_graph(nodes, edges, str(tmp_path / "g"))
    assert [df.count() for df in io.read_graph(spark, str(tmp_path / "g"))] == [1, 1]
    (tmp_path / "g.json").write_text(io.to_node_link(nodes, edges).first().json)
    assert [df.count() for df in io.read_node_link(spark, str(tmp_path / "g.json"))] == [1, 1]
    io.append_jsonl(nodes, str(tmp_path / "j"))
    io.append_jsonl(nodes, str(tmp_path / "j"))
    assert io.read_jsonl(spark, str(tmp_path / "j"), "id INT, kind STRING").count() == 2
    io.write_report(spark.createDataFrame([("a", 1.5)], "n STRING, v DOUBLE"), str(tmp_path / "csv"))
    assert any('"1,5000"' in p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    built = []
    make = lambda: built.append(1) or nodes
    for _ in range(2):
        assert io.load_or_build(spark, str(tmp_path / "t"), make).count() == 1
    assert built == [1]
    with pytest.raises(ValueError):
        io.with_column(nodes, "id", "TEXT")
    assert io.next_report_index(spark.createDataFrame([("r_4.txt",), ("r_12.txt",), ("x",)], "name STRING")).first().next_index == 13


def test_ingestion_over_batches(spark, tmp_path):
    d = lambda *r: spark.createDataFrame(r, "id INT, text STRING")
    store = str(tmp_path / "store")
    assert rows(ingest.apply_batch(spark, d((1, "a"), (2, "b")), store, 0)) == [(1, "insert"), (2, "insert")]
    assert rows(ingest.apply_batch(spark, d((2, "c"), (3, "x"), (1, "a")), store, 1)) == [(1, "unchanged"), (2, "update"), (3, "insert")]
    assert {r.id: r.text for r in spark.read.parquet(f"{store}/v=1").collect()} == {1: "a", 2: "c", 3: "x"}


def test_stream_and_table_agree(spark, tmp_path):
    e = spark.createDataFrame([(i, f"2024-01-01 00:{i % 60:02d}:00", i % 3, "click", 1.0) for i in range(200)], "event_id INT, ts STRING, user_id INT, event_type STRING, value DOUBLE").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "events"))
    q = windows.windowed(stream, "10 minutes").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert rows(spark.table("w")) == rows(windows.windowed(e, "10 minutes"))
