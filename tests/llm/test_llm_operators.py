import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from codeplane.llm import files, mixing, packing, quality, queries, syntax, tokens

CHUNKS = "repo_id INT, chunk_id STRING, file_path STRING, file_name STRING, file_type STRING, category STRING, ord INT, start_line INT, end_line INT, tokens INT, span_ids ARRAY<STRING>, imports MAP<STRING, ARRAY<STRING>>, content STRING, input_type STRING, summary STRUCT<long_description: STRING, short_description: STRING, questions: ARRAY<STRING>>, indexed_at TIMESTAMP_NTZ"
DOCUMENTS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, domain STRING, repo_id INT, file_path STRING, created_at TIMESTAMP_NTZ"
USAGE = "call_id BIGINT, session_id STRING, model STRING, function_name STRING, repo_id INT, chunk_id STRING, prompt_tokens INT, cached_tokens INT, completion_tokens INT, latency_ms DOUBLE, created_at TIMESTAMP_NTZ, arrived_at TIMESTAMP_NTZ"
OTHERS = {"quality_labels": "doc_id BIGINT, label STRING, annotator STRING, labelled_at TIMESTAMP_NTZ", "size_limits": "purpose STRING, max_tokens INT, overlap_tokens INT", "mix_targets": "source STRING, target_share DOUBLE, max_repeats INT"}
T0 = dt.datetime(2024, 1, 1)
PROSE = "It took the team nine days to find out why the parser had counted the wrong branches, and nobody knew it before. "


def chunk(repo, path, n, text, later=0, start=1, **more):
    row = dict.fromkeys([f.split(":")[0].split()[0] for f in ("repo_id chunk_id file_path file_name file_type category ord start_line end_line tokens span_ids imports content input_type summary indexed_at").split()])
    row |= {"repo_id": repo, "file_path": path, "ord": n, "content": text, "start_line": start, "end_line": start + (text or "").count("\n"), "indexed_at": T0 + dt.timedelta(days=later), "chunk_id": f"{path}::{n}"} | more
    return tuple(row.values())


@pytest.fixture(scope="module")
def scale(spark, tmp_path_factory):
    """Folders with empty tables, with tables of nothing but nulls, and with a little of everything; each with extra columns."""
    root = tmp_path_factory.mktemp("scale")

    def write(kind, name, schema, rows):
        df = spark.createDataFrame(rows, schema)
        df.withColumn("n", F.lit(1)).withColumn("row", F.lit("x")).withColumn("parts", F.lit(2)).withColumn("score", F.lit(0.5)).withColumn("key", F.lit(1)).write.parquet(f"{root}/{kind}/{name}.parquet")

    every = {"chunks": CHUNKS, "documents": DOCUMENTS, "token_usage": USAGE, **OTHERS}
    for name, schema in every.items():
        write("empty", name, schema, [])
        write("null", name, schema, [tuple([None] * (schema.count(",") + 1 if "STRUCT" not in schema else 16))] * 3 if name != "chunks" else [tuple([None] * 16)] * 3)
    huge = "x = [" + "1, " * 30_000 + "]\n"
    rows = [
        chunk(1, "a/b.py", 1, 'def f():\n    """Say what this one does."""\n    return 1'), chunk(1, "./a/b.py", 1, 'def f():\n    """Say what this one does."""\n    return 1', 5), chunk(1, "a\\b.py", 2, "def g(:\n  pass", 0, 4),
        chunk(1, "c.py", 1, 'def h():\n    """Say what that one does."""\n'), chunk(1, "c.py", 2, "    return 2\nPASSWORD = 'Willow!harbor-6856'\n", 0, 4), chunk(1, "empty.py", 1, ""), chunk(2, "null.js", 1, None), chunk(None, "x.json", 1, "{}"), chunk(2, None, 1, "x"), chunk(2, "a.json", None, "{'a': 1}"),
        chunk(2, "big.py", 1, huge), chunk(2, "node_modules/x/i.js", 1, "f();\r\n"), chunk(2, "noending", 1, "token = 1"),
    ]
    write("some", "chunks", CHUNKS, rows)
    docs = [(1, PROSE * 3, "en", "readme"), (2, None, None, None), (3, "  ", "EN", "README"), (4, "| a | b |\n" * 50, "en-US", "chat-answer"), (5, PROSE * 3, "en", "readme"), (6, PROSE * 400, "de", " walkthrough"), (7, "", "en", "readme")]
    write("some", "documents", DOCUMENTS, [(*d, None, None, None, None, T0) for d in docs])
    write("some", "token_usage", USAGE, [(1, "s", "m", "f", 1, "c.py::1", 100, 0, 5, 1.0, T0, T0), (1, "s", "m", "f", 1, "c.py::1", 100, 0, 5, 1.0, T0, T0 + dt.timedelta(days=1)), (2, "s", None, "f", None, None, None, None, None, None, T0, T0)])
    write("some", "quality_labels", OTHERS["quality_labels"], [(4, "not_prose", "a", T0), (1, "prose", "a", T0), (1, "not_prose", "b", T0), (99, "prose", "b", T0)])
    write("some", "size_limits", OTHERS["size_limits"], [("chunk_split", 2000, 100), ("prompt_pack", 4096, None), ("train_pack", 8192, None), ("embed_pack", 512, None)])
    write("some", "mix_targets", OTHERS["mix_targets"], [("readme", 0.5, 2), ("walkthrough", 0.3, 1), ("nothing", 0.2, 3)])
    return str(root)


@pytest.mark.parametrize("name", sorted(queries.queries()))
@pytest.mark.parametrize("kind", ["empty", "null", "some"])
def test_every_query_takes_any_table(spark, scale, name, kind):
    rows = queries.queries()[name](spark, f"{scale}/{kind}").collect()
    if kind == "empty":
        assert rows == [] or name in ("p3_budget",)


def found(spark, scale, name):
    return sorted(tuple(r) for r in queries.queries()[name](spark, f"{scale}/some").collect())


def test_found(spark, scale):
    assert found(spark, scale, "p1_found") == [(2, "big.py"), (2, "node_modules/x/i.js")]
    assert found(spark, scale, "p2_found") == [(1, "a/b.py"), (2, "a.json")]
    assert found(spark, scale, "p4_found") == [(2, "big.py", 1)]
    assert found(spark, scale, "p5_found") == [(1, "c.py", "h", 1)]
    assert found(spark, scale, "p6_found") == [(1, "c.py", 5)]
    assert found(spark, scale, "p9_found") == [(2,), (3,), (4,), (6,), (7,)]  # 6 is one sentence over and over


def test_files_join_chunks_in_order_and_take_repeats_once(spark, scale):
    f = {(r.repo_id, r.file_path): r.content for r in files.files(spark.read.parquet(f"{scale}/some/chunks.parquet")).collect()}
    assert f[1, "a/b.py"] == 'def f():\n    """Say what this one does."""\n    return 1\ndef g(:\n  pass'
    assert f[2, "null.js"] == "" and (None, "x.json") in f and len(f) == 9


def test_rates_have_totals(spark, scale):
    rows = {(r.repo_id, r.language, r.is_total): (r.n_files, r.n_invalid) for r in syntax.syntax_rates(spark.read.parquet(f"{scale}/some/chunks.parquet")).collect()}
    assert rows[None, "python", True] == (4, 1) and rows[1, "python", False] == (3, 1) and rows[None, "json", True] == (2, 1)


def test_exact_ranks_with_a_value_that_a_third_share(spark):
    random.seed(3)
    data = [(i, random.choice("ab"), random.choice([0.0, 0.0, 0.0, 1.0, random.random()])) for i in range(3000)]
    df = spark.createDataFrame(data, "id INT, g STRING, v DOUBLE")
    got = quality.exact_ranks(df, ["g"], "v", "id").toPandas().set_index("id").sort_index()
    p = pd.DataFrame(data, columns=["id", "g", "v"]).set_index("id")
    by = p.groupby("g")["v"]
    assert (got.n_least == by.rank(method="max")).all() and (got.n_less == by.rank(method="min") - 1).all() and (got.n_group == by.transform("size")).all()


def test_running_sums_with_one_hot_group(spark):
    random.seed(4)
    data = [(i, "hot" if i % 3 else "b", random.random(), random.randint(1, 9)) for i in range(2000)]
    df = spark.createDataFrame(data, "id INT, g STRING, k DOUBLE, v INT")
    got = mixing.running_sums(df, "g", ["k", "id"], "v").toPandas().set_index("id").sort_index()
    p = pd.DataFrame(data, columns=["id", "g", "k", "v"]).sort_values(["k", "id"])
    p["s"] = p.groupby("g")["v"].cumsum()
    assert (got.running == p.set_index("id").sort_index().s).all()


def test_mixing_keeps_to_shares_and_repeats(spark):
    docs = spark.createDataFrame([(i, PROSE * (1 + i % 4), "en", ["readme", "Walkthrough", "issue-note"][i % 3 if i < 600 else 0]) for i in range(900)], "doc_id BIGINT, text STRING, lang STRING, source STRING")
    targets = spark.createDataFrame([("readme", 0.2, 1), ("walkthrough", 0.5, 3), ("issue_note", 0.2, 2), ("none", 0.1, 1)], "source STRING, target_share DOUBLE, max_repeats INT")
    drawn, plan = mixing.draw(docs, targets)
    rows = {r.source: r for r in mixing.shares(drawn, plan).collect()}
    assert all(r.most_times <= r.max_repeats for r in rows.values())
    for s, share in (("readme", 2 / 9), ("walkthrough", 5 / 9), ("issue_note", 2 / 9)):
        assert abs(rows[s].reached_share - share) < 0.02
    assert rows["none"].reached_share == 0
    again = {(r.doc_id, r.times) for r in mixing.draw(docs.repartition(7), targets)[0].collect()}
    assert again == {(r.doc_id, r.times) for r in drawn.collect()}


def test_packing_loses_nothing(spark):
    docs = spark.createDataFrame([(i, "word " * (i * 7 % 900)) for i in range(400)], "doc_id BIGINT, text STRING")
    limits = spark.createDataFrame([("embed_pack", 512, None), ("train_pack", 4096, None)], "purpose STRING, max_tokens INT, overlap_tokens INT")
    bins = packing.packed(docs, limits, items=100)
    sizes = {r.doc_id: r.n_tokens for r in tokens.with_tokens(docs, "text").collect()}
    per = bins.groupBy("purpose", "doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert {(r.purpose, r.doc_id): r.n for r in per} == {(p, d): n for p in ("embed_pack", "train_pack") for d, n in sizes.items() if n}
    assert all(r.fullest <= r.capacity and r.n_bins >= r.least_bins and r.fill_rate > 0.85 for r in packing.fill(bins).collect())


def test_budget_sums_agree_with_texts(spark, scale):
    rows = queries.queries()["p3_tokens"](spark, f"{scale}/some")
    want = {r.origin: r.n for r in rows.groupBy("origin").agg(F.sum("n_tokens").alias("n")).collect()}
    got = {r.origin: r.n_tokens for r in queries.queries()["p3_budget"](spark, f"{scale}/some").where("is_total").collect()}
    assert got == want
