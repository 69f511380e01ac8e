"""Queries against brute force where only a part of the rows was read before."""

import ast
import datetime
import random

from pyspark.sql import functions as F

from codeplane.operators import extract, graphs, patches
from codeplane.plans import code

CHUNKS = "repo_id INT, file_path STRING, ord INT, indexed_at TIMESTAMP, chunk_id STRING, content STRING, span_ids ARRAY<STRING>, imports MAP<STRING, ARRAY<STRING>>"


def chunks(spark, rows):
    """Rows of (repo_id, file_path, ord, span_ids, imports) as a table of chunks."""
    at = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(r, p, o, at, f"{p}::{o}", "", s, i) for r, p, o, s, i in rows], CHUNKS)


def test_name_edges_reach_every_chunk(spark):
    rnd = random.Random(5)
    names = [f"n{i}" for i in range(40)]
    table = [(r, f"d{f}/f.py", o, rnd.sample(names, 2), {"m": rnd.sample(names, 3)}) for r in range(3) for f in range(2) for o in range(8)]
    c = chunks(spark, table)
    key = lambda row: f"{row[0]}:{row[1]}:{row[2]}"
    edges = {(key(a), key(b), next(n for n in a[4]["m"] if n in b[3])) for a in table for b in table if a[0] == b[0] and key(a) != key(b) and set(a[4]["m"]) & set(b[3])}
    assert {(r.src, r.dst, r.name) for r in code.n15(lambda _: c).collect()} == edges
    counts: dict = {}
    for a, b, _ in edges:
        pair = a.split("/")[0], b.split("/")[0]
        if pair[0] != pair[1]:
            counts[pair] = counts.get(pair, 0) + 1
    assert {(r.src_cluster, r.dst_cluster): r.n_edges for r in code.n16(lambda _: c).collect()} == counts


def test_every_call_is_one_relationship(spark):
    text = """
@deco(1)
def f(a=default(), *, b: note()=other()) -> ret():
    if test(a) or [inner(x) for x in it(a)]:
        body()
    elif test2():
        pass
    for x in items():
        body2()
    while cond(): step()
    with open(p) as h, lock():
        h.read()
    try:
        risky()
    except errors():
        handle()
    match subject():
        case C() if guard():
            arm()
async def g():
    async for x in source():
        await use(x)
    async with session():
        pass
@cls_deco()
class A(base(), metaclass=meta()):
    x = field()
"""
    long = ".".join(f"part{i}" for i in range(60))
    text += f"{long}.a()\n{long}.b()\n{long} = 1\n"
    files = spark.createDataFrame([(1, "f.py", text)], "repo_id INT, file_path STRING, content STRING")
    blocks = extract.blocks(files).collect()
    calls = sorted(r.target for b in blocks for r in b.relationships if r.kind == "calls")
    assert calls == sorted(ast.unparse(n.func) for n in ast.walk(ast.parse(text)) if isinstance(n, ast.Call))
    assert long in [b.identifier for b in blocks]
    of = {r.target: (b.type, b.identifier) for b in blocks for r in b.relationships if r.kind == "calls"}
    assert of["deco"] == of["default"] == ("function", "f") and of["test"] == ("compound", "if") and of["handle"][0] == "statement" and of["errors"] == ("compound", "try") and of["guard"] == ("compound", "match")


def test_communities_go_on_until_no_move_shortens_the_description(spark):
    links = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(10) for _ in range(10 - i)] + [(f"x{i}", f"y{j}") for i in range(3) for j in range(3)]
    edges = spark.createDataFrame(links, "src STRING, dst STRING")
    label = {r.node: r.community for r in graphs.communities(edges).collect()}
    bits = lambda l: graphs.codelength(edges, spark.createDataFrame(list(l.items()), "node STRING, community STRING")).first().codelength
    least = bits(label)
    assert least < bits(dict.fromkeys(label, "one")) and least < bits({v: v for v in label})
    for node in ("n00", "n04", "n05", "n10", "x1"):
        near = {label[b if node == a else a] for a, b in links if node in (a, b)} - {label[node]}
        assert all(least <= bits(label | {node: c}) + 1e-9 for c in near)


def test_expansion_goes_on_until_the_budget_is_spent(spark):
    edges = spark.createDataFrame([(g, f"n{i:02d}", f"n{i + 1:02d}") for g in (1, 2) for i in range(7)], "g INT, src STRING, dst STRING")
    tokens = spark.createDataFrame([(g, f"n{i:02d}", g) for g in (1, 2) for i in range(8)], "g INT, node STRING, tokens INT")
    seeds = spark.createDataFrame([(1, "n00"), (2, "n00")], "g INT, node STRING")
    got = sorted((r.g, r.node, r.level, r.sum_tokens) for r in patches.expanded(seeds, edges, tokens, 11, "g").collect())
    assert got == [(1, f"n{i:02d}", i, i + 1) for i in range(8)] + [(2, f"n{i:02d}", i, 2 * i + 2) for i in range(5)]
