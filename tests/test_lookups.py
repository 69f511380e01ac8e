"""Lookups, edits, imports, hunks, communities and stores on fixtures worked out by hand or by brute force."""

import itertools
import math
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeplane.functions import exprs as X
from codeplane.operators import chunking, extract, graphs, ordered, patches, render, scopes, search, trees, vectors
from codeplane.plans.code import SYSTEM, THIRD_PARTY
from codeplane.sources import store

FILES = "repo_id INT, file_path STRING, content STRING"


def files(spark, *rows):
    return spark.createDataFrame([(1, p, t) for p, t in rows], FILES)


def local(spark, f):
    caps = graphs.checkpointed(extract.captures(f))
    sc = scopes.scope_table(caps)
    rows = scopes.placed(caps, sc)
    i = caps.where("kind = 'import'").select("repo_id", "file_path", "name", F.regexp_replace("sub", r"^\.+", "").alias("module"))
    return caps, sc, rows, scopes.module_files(i, f.select("repo_id", "file_path")), scopes.exports(rows)


def test_imports_reach_definitions_and_chunks_also_through_packages(spark):
    f = files(
        spark, ("pkg/__init__.py", "from pkg.a import make\nfrom pkg.b import Thing\n"), ("pkg/a.py", "def make():\n    return 1\n"), ("pkg/b.py", "class Thing:\n    pass\n"),
        ("use.py", "from pkg import make, Thing\nfrom pkg.a import make as other\nimport os\n\ndef f():\n    return make()\n\nclass C(Thing):\n    pass\n"), ("direct.py", "from pkg.b import Thing\n\nx = Thing()\n"),
    )
    caps, sc, rows, imports, exported = local(spark, f)
    pairs = {(r.file_path, r.name, r.target) for r in scopes.import_exports(imports, exported).collect()}
    assert {("use.py", "make", "pkg/a.py"), ("use.py", "Thing", "pkg/b.py"), ("direct.py", "Thing", "pkg/b.py"), ("pkg/__init__.py", "make", "pkg/a.py"), ("pkg/__init__.py", "Thing", "pkg/b.py")} == pairs
    edges = scopes.repo_edges(rows, imports, exported)
    assert {(r.file_path, r.name, r.target) for r in edges.collect()} == {("use.py", "make", "pkg/a.py"), ("use.py", "Thing", "pkg/b.py"), ("direct.py", "Thing", "pkg/b.py")}
    chunks = spark.createDataFrame([(1, "use.py", 1, 1, 4), (1, "use.py", 2, 5, 9), (1, "pkg/a.py", 1, 1, 2), (1, "pkg/b.py", 1, 1, 2), (1, "direct.py", 1, 1, 3)], "repo_id INT, file_path STRING, ord INT, start_line INT, end_line INT")
    got = {(r.file_path, r.src_ord, r.target, r.dst_ord) for r in scopes.chunk_edges(edges, chunks, sc, caps).collect()}
    assert ("use.py", 2, "pkg/a.py", 1) in got and ("direct.py", 1, "pkg/b.py", 1) in got


def test_modules_are_classified():
    assert {"os", "asyncio", "unittest"} <= set(SYSTEM) and "numpy" in THIRD_PARTY and "numpy" not in SYSTEM


def test_references_are_found_outward(spark):
    text = "import os.path\n\ndef helper():\n    pass\n\nclass A:\n    def helper(self):\n        pass\n    def run(self):\n        def inner():\n            helper()\n        inner()\n        os.path()\n\ndef last():\n    helper()\n    missing()\n"
    tree = graphs.checkpointed(extract.blocks(files(spark, ("m.py", text))))
    at = {r.path: r.block for r in tree.collect()}
    refs = spark.createDataFrame([(1, "m.py", at["A.run.inner"], "helper"), (1, "m.py", at["A.run"], "inner"), (1, "m.py", at["last"], "helper"), (1, "m.py", at["last"], "missing"), (1, "m.py", at["last"], "A.run"), (1, "m.py", at["A.run"], "os.path")], "repo_id INT, file_path STRING, block INT, ref STRING")
    got = {(r.block, r.ref): (r.scope, r.target) for r in trees.found_references(tree, refs).collect()}
    assert got == {
        (at["A.run.inner"], "helper"): ("class", "A.helper"), (at["A.run"], "inner"): ("local", "A.run.inner"), (at["last"], "helper"): ("global", "helper"), (at["A.run"], "os.path"): ("external", "os.path"),
    }


def test_updates_are_accepted_or_refused(spark):
    old = files(spark, ("a.py", "def f():\n    return 1\n"), ("b.py", "x = 1\n"), ("c.py", "x = 1\n"), ("d.py", "x = 1\n"), ("e.py", "# ... the rest of the code\nx = 1\n"), ("n.py", None))
    new = files(spark, ("a.py", "def f():\n    return 2\n\ndef g():\n    pass\n"), ("b.py", "x = (\n"), ("c.py", "x = 1\n"), ("d.py", "# ... existing code\nx = 2\n"), ("e.py", "# ... the rest of the code\nx = 2\n"), ("n.py", None))
    got = {r.file_path: (r.accepted, r.reason, r.new_blocks) for r in trees.accepted_updates(old, new).collect()}
    assert got["a.py"][:2] == (True, None) and "g" in got["a.py"][2] and got["b.py"][:2] == (False, "invalid code") and got["c.py"][:2] == (False, "unchanged")
    assert got["d.py"][:2] == (False, "code is left out") and got["e.py"][0] and got["n.py"][:2] == (False, "unchanged")


def test_children_are_put_in_taken_away_and_swapped(spark):
    ch = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "z")], "parent INT, pos INT, child STRING")
    order = lambda df: {p: [r.child for r in sorted(rows, key=lambda r: r.pos)] for p, rows in itertools.groupby(sorted(df.collect(), key=lambda r: r.parent), key=lambda r: r.parent)}
    new = spark.createDataFrame([(1, 1, "n"), (1, 9, "end"), (3, 0, "only")], "parent INT, pos INT, child STRING")
    assert order(trees.inserted(ch, new)) == {1: ["a", "n", "b", "c", "end"], 2: ["z"], 3: ["only"]}
    assert order(trees.removed(ch, spark.createDataFrame([(1, "b"), (2, "none")], "parent INT, child STRING"))) == {1: ["a", "c"], 2: ["z"]}
    assert order(trees.replaced(ch, spark.createDataFrame([(1, "b", "B"), (9, "x", "y")], "parent INT, child STRING, new STRING"))) == {1: ["a", "B", "c"], 2: ["z"]}
    t = spark.createDataFrame([("a\n\n  b",), (None,)], "t STRING")
    assert [r[0] for r in t.select(trees.indented(F.col("t"), 2)).collect()] == ["  a\n\n    b", None] and t.select(trees.indented(F.col("t"), -2)).first()[0] == "a\n\nb"


def test_hunks_of_new_files_are_their_own(spark):
    git = "diff --git a/one.py b/one.py\n--- a/one.py\n+++ b/one.py\n@@ -10,9 +10,9 @@\n x\ndiff --git a/new.py b/new.py\n--- /dev/null\n+++ b/new.py\n@@ -0,0 +1,5 @@\n+y\n"
    plain = "--- a/old.py\n+++ b/old.py\n@@ -1,8 +1,8 @@\n"
    p = spark.createDataFrame([(1, git), (2, plain), (3, "@@ -1,2 +1,2 @@\n"), (4, None)], "k INT, content STRING")
    assert sorted((r.k, r.file, r.start, r.end) for r in extract.hunks(p, ["k"]).collect()) == [(1, "new.py", 1, 1), (1, "one.py", 13, 15), (2, "old.py", 2, 3)]


def test_patches_meet_spans_of_their_own_repository(spark):
    h = spark.createDataFrame([(1, "p", "a.py", 3, 5)], "repo_id INT, patch STRING, file STRING, start INT, end INT")
    s = spark.createDataFrame([(1, "a.py", "f", 1, 4), (1, "a.py", "g", 6, 9), (2, "a.py", "other", 1, 9)], "repo_id INT, file STRING, span_id STRING, s INT, e INT")
    assert [(r.repo_id, r.file, r.spans) for r in patches.patch_spans(h, s, ["repo_id", "patch"]).collect()] == [(1, "a.py", ["f"])]


def test_java_blocks(spark):
    text = 'package p;\nimport java.util.List;\n\n/** class No { } */\npublic class A<T> extends B implements C, D {\n  String s = "{";\n  A(int x) { this.x = x; }\n  @Override\n  public List<T> get(final Map<K, V> m, int[] y) throws E {\n    if (m == null) { return null; }\n    Runnable r = new Runnable() { public void run() { } };\n    return y;\n  }\n  enum Kind { ONE, TWO }\n}\ninterface I { void f(); }\n'
    rows = {r.path: r for r in extract.java_blocks(files(spark, ("A.java", text), ("B.java", None), ("C.java", "class Open {\n  void f() {\n"))).collect() if r.file_path == "A.java"}
    assert [(p, rows[p].type, rows[p].start_line, rows[p].end_line) for p in ("java.util.List", "A", "A.A", "A.get", "A.Kind", "I")] == [
        ("java.util.List", "import", 2, 2), ("A", "class", 5, 15), ("A.A", "constructor", 7, 7), ("A.get", "function", 8, 13), ("A.Kind", "enum", 14, 14), ("I", "interface", 16, 16),
    ]
    assert rows["A.get"].params == ["m", "y"] and [r.target for r in rows["A"].relationships] == ["B", "C", "D"]


def test_closeness_counts_the_anchor_and_repeated_indexes(spark):
    m = spark.createDataFrame([(1, 1, 0, 0, 600), (1, 2, 1, 600, 600), (1, 3, 1, 600, 600), (1, 4, 0, 0, 600), (1, 5, 3, 1900, 1)], "cluster_id INT, pos INT, idx INT, before INT, bytes INT")
    assert ordered.closeness_bytes(m, 1000).first().closeness == pytest.approx(2 / 5)


def test_context_ends_with_the_first_that_does_not_fit(spark):
    one = lambda rows, names: spark.createDataFrame([(1, *r) for r in rows], "g INT, " + names)
    context, spans = one([("a", 50), ("b", 20)], "span_id STRING, tokens INT"), one([("a", 50), ("b", 20), ("c", 10), ("d", 40), ("e", 1)], "span_id STRING, tokens INT")
    near = one([("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "e")], "span_id STRING, related STRING")
    assert sorted(r.span_id for r in chunking.expanded_context(context, near, spans, 130, ["g"]).collect()) == ["c", "d"]
    assert chunking.expanded_context(context, near, spans, 60, ["g"]).collect() == []


def test_closures_end_on_cycles_and_take_deep_trees(spark):
    tree = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child STRING, parent STRING")
    assert sorted((r.node, r.ancestor, r.depth) for r in graphs.ancestors(tree).collect()) == sorted((x, y, d) for x, ys in (("a", "bca"), ("b", "cab"), ("c", "abc")) for d, y in enumerate(ys, 1))
    none = spark.createDataFrame([], "child STRING, parent STRING")
    assert graphs.ancestors(none).count() == 0


def _bits(edges, label):
    w, out, flow, total = {}, {}, {}, 2 * len(edges)
    plogp = lambda x: x * math.log2(x) if x > 0 else 0
    for a, b in edges:
        for x, y in ((a, b), (b, a)):
            w[x] = w.get(x, 0) + 1 / total
            flow[label[x]] = flow.get(label[x], 0) + 1 / total
            if label[x] != label[y]:
                out[label[x]] = out.get(label[x], 0) + 1 / total
    return plogp(sum(out.values())) - 2 * sum(plogp(x) for x in out.values()) - sum(plogp(x) for x in w.values()) + sum(plogp(out.get(m, 0) + flow[m]) for m in flow)


def _partitions(items):
    if not items:
        yield []
        return
    for rest in _partitions(items[1:]):
        for i in range(len(rest)):
            yield [*rest[:i], [items[0], *rest[i]], *rest[i + 1 :]]
        yield [[items[0]], *rest]


def test_communities_shorten_the_map_equation_as_far_as_any_partition():
    edges = [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5)]
    both = [*edges, *((b, a) for a, b in edges)]
    found, *_ = graphs.small_modules([a for a, _ in both], [b for _, b in both], [1 / len(both)] * len(both))
    best = min(_bits(edges, {v: i for i, p in enumerate(ps) for v in p}) for ps in _partitions(list(range(6))))
    assert _bits(edges, found) == pytest.approx(best)
    r = random.Random(4)
    edges = [(a, b) for a in range(24) for b in range(a + 1, 24) if r.random() < (0.7 if a // 6 == b // 6 else 0.04)]
    both = [*edges, *((b, a) for a, b in edges)]
    found, *_ = graphs.small_modules([a for a, _ in both], [b for _, b in both], [1 / len(both)] * len(both))
    nodes = {v for e in edges for v in e}
    assert _bits(edges, found) <= min(_bits(edges, {v: v // 6 for v in nodes}), _bits(edges, dict.fromkeys(nodes, 0)), _bits(edges, {v: v for v in nodes})) + 1e-9


def test_large_components_are_searched_by_all_tasks(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5), (8, 9)], "src INT, dst INT")
    of = lambda small: {r.node: r.community for r in graphs.communities(e, small=small).collect()}
    assert of(200_000) == of(3) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 8: 8, 9: 8}
    assert {r.node: r.component for r in graphs.components(e.union(e.select("dst", "src"))).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 8: 8, 9: 8}


def test_knn_is_that_of_brute_force_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 30)
    g = np.random.default_rng(1)
    v = g.normal(size=(120, 4)).round(2)
    v[60:70] = v[10]  # ties
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in vectors.knn(df, df.where("vec_id % 6 = 0"), 5).collect()}
    for q in range(0, 120, 6):
        d = ((v - v[q]) ** 2).sum(1)
        assert [got[q, n] for n in range(1, 6)] == sorted(range(120), key=lambda i: (d[i], i))[:5]


def test_places_in_a_total_order(spark):
    df = spark.createDataFrame([(i * 37 % 101, i % 3) for i in range(101)], "v INT, w INT").repartition(7)
    assert [(r.v, r.n) for r in sorted(ordered.numbered(df, [F.desc("v")]).collect(), key=lambda r: r.n)] == [(100 - i, i + 1) for i in range(101)]
    assert ordered.numbered(df.limit(0), [F.col("v")]).count() == 0


def test_unique_lookups_and_names(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (1, "b", "z")], "r INT, k STRING, v STRING")
    assert {r.k: (r.v, r.is_error) for r in search.unique(df, ["r", "k"], "v").collect()} == {"a": ("x", False), "b": (None, True)}
    t = spark.createDataFrame([("see [[a b]] and [[c]]",), (None,)], "t STRING")
    assert [r[0] for r in t.select(X.double_bracket_refs(F.col("t"))).collect()] == [["a b", "c"], None]


def test_prompts_mark_gaps_and_stop_at_the_limit(spark):
    c = spark.createDataFrame([(1, "a.py", 1, 1, 2, 10, ["f"], "x\ny"), (1, "a.py", 2, 5, 5, 10, None, None), (1, "a.py", 3, 6, 6, 99, [], "z")], "repo_id INT, file_path STRING, ord INT, start_line INT, end_line INT, tokens INT, span_ids ARRAY<STRING>, content STRING")
    assert [r.text for r in render.prompt_pieces(c, 50).orderBy("ord").collect()] == ["<span ids='f'>\n     1\tx\n     2\ty\n</span>", "...\n<span ids=''>\n     5\t\n</span>"]
    with pytest.raises(Exception):
        render.mapped(c, "content", lambda xs: xs[:-1], "s").collect()


def test_databases_are_listed(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    db = sqlite3.connect(tmp_path / "sub" / "one.db")
    db.execute("CREATE TABLE t (x)")
    db.commit()
    db.close()
    (tmp_path / "two.db").write_bytes(b"no database")
    got = {r.path.rsplit("/", 1)[1]: r.is_valid for r in store.find_databases(spark, str(tmp_path)).collect()}
    assert got == {"one.db": True, "two.db": False}
    assert store.truncated(spark.range(3), False).count() == 3 and store.truncated(spark.range(3), True).count() == 0


def test_deep_files_are_whole(spark):
    n = 300
    text = "".join("    " * i + f"def f{i}():\n" for i in range(90)) + "    " * 90 + "x = " + "+".join(["g()"] * n) + "\n"
    rows = extract.blocks(files(spark, ("d.py", text))).collect()
    assert sum(r.type == "function" for r in rows) == 90 and sum(len(r.relationships) for r in rows) == n


def test_sweeps_find_what_all_pairs_would():
    r = random.Random(8)
    for _ in range(60):
        sc = [(a, a + r.randrange(6), i) for i, a in enumerate((r.randrange(20) for _ in range(r.randrange(12))), 1)]
        rg = {(a, a + r.randrange(3)) for a in (r.randrange(20) for _ in range(10))}
        want = {(s, e): min(((b - a, i) for a, b, i in sc if a <= s and e <= b), default=None) for s, e in rg}
        assert {(s, e): i for s, e, i in scopes._enclosing(list(rg), sc)} == {k: v[1] for k, v in want.items() if v}
        tree = [(i, a, b) for i, (a, b, _) in enumerate(sorted(sc), 1)]
        up = {i: min(((q[2] - q[1], -q[0]) for q in tree if q[0] < i and q[1] <= a and b <= q[2]), default=(0, 0)) for i, a, b in tree}
        assert dict(scopes._parents(tree)) == {i: -k for i, (_, k) in up.items()}
