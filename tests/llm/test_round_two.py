"""Deep and long texts, results that must not depend on what was read before, and scores that decide."""

import random
import time

import pytest

from codeplane.llm import docpairs, quality, syntax, textstats, tokens

N = 1500
DEEP = [
    ("js", "x = " + "[" * N + "]" * N + ";\n"), ("js", "x = " + "(" * N + "1" + ")" * N + ";\n"), ("js", "if (a) { b(); }" + " else if (c) { d(); }" * N + "\n"), ("js", "x = " + "a ? b : " * N + "c;\n"),
    ("java", "class A { int f() { return " + "(" * N + "1" + ")" * N + "; } }\n"), ("java", "class A { void f() { if (a) { b(); }" + " else if (c) { d(); }" * N + " } }\n"), ("json", "[" * N + "]" * N),
    ("yaml", "a: " + "[" * N + "]" * N + "\n"), ("toml", "a = " + "[" * N + "]" * N + "\n"), ("py", "x = " + "a if b else " * N + "c\n"), ("py", "x = " + "[" * 150 + "]" * 150 + "\n"),
]


@pytest.mark.parametrize("ending,text", DEEP)
def test_depth_is_no_error(ending, text):
    assert syntax.syntax_errors(ending, text) == []
    assert syntax.syntax_errors(ending, text.replace("]", "", 1) if "]" in text else text.replace(")", "", 1) if ")" in text else text + "(")


def test_functions_behind_deep_code_are_found():
    text = "x = " + "(" * N + "1" + ")" * N + ";\n// Gives the sum of all the parts.\nfunction f(a) { return a; }\n"
    assert [x[3] for x in docpairs._each(1, "a.js", text)] == ["f"]


@pytest.mark.parametrize(
    "text,valid",
    [("break;\n", False), ("continue;\n", False), ("super(a);\n", False), ("for(;;){break;}\n", True), ("switch(a){case 1: break;}\n", True), ("switch(a){case 1: continue;}\n", False), ("a: { break a; }\n", True), ("for(;;){ function f(){ break; } }\n", False),
     ("class A extends B { constructor(){ super(1); super.x(); } }\n", True), ("class A { constructor(){ super(1); } }\n", False), ("x = { f() { return super.f(); } };\n", True), ("function f(){ super.x(); }\n", False),
     ("function f(){ for(;;){ if(a) { break; } } if (a) { break; } }\n", False), ("class A extends B { f = () => super.g(); static { super.y(); } }\n", True)],
)
def test_jumps_and_super_stand_where_they_may(text, valid):
    assert (not syntax.syntax_errors("js", text)) == valid


def test_documented_functions_do_not_depend_on_files_read_before():
    broken = "@d\ndef f(alpha, beta, gamma, delta, eps\n"
    whole = '@d\ndef f(alpha, beta, gamma, delta, eps, zeta):\n    """Gives the sum of all the parts."""\n'
    alone = list(docpairs._each(1, "b.py", whole))
    assert list(docpairs._each(1, "a.py", broken)) == [] and list(docpairs._each(1, "b.py", whole)) == alone and len(alone) == 1


def test_long_pieces_are_counted_as_by_the_library_and_in_time():
    import tiktoken

    m = tokens.merger(tokens.VOCABULARY)
    enc = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=m.ranks, special_tokens={})
    r = random.Random(5)
    for size in (tokens.LONG - 1, tokens.LONG, tokens.LONG + 1, 700, 4000):
        for letters in ("abcdefghijklmnopqrstuvwxyzé", "ab", "=-"):
            text = "".join(r.choice(letters) for _ in range(size))
            assert m.count([text]) == [len(enc.encode_ordinary(text))]
    began = time.time()
    m.count(["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000))])
    assert time.time() - began < 60


PROSE = {
    "it": "Il pianificatore conserva ogni frammento finché la cache non lo chiede di nuovo. Ho provato a unire prima il grafo, ma spesso era già stato letto da un altro processo.",
    "nl": "De planner bewaart elk fragment totdat de cache er opnieuw om vraagt. Ik heb eerst geprobeerd de graaf te koppelen, maar die was vaak al door een ander proces gelezen.",
    "pt": "O planejador guarda cada fragmento até que o cache o peça novamente. Tentei primeiro ligar o grafo, mas muitas vezes ele já tinha sido lido por outro processo.",
    "ru": "Планировщик хранит каждый фрагмент, пока кэш не попросит его снова. Сначала я попробовал связать граф, но он часто уже был прочитан другим процессом.",
    "ja": "計画係はキャッシュが再び要求するまで各断片を保持します。最初にグラフを接続しようとしました。",
}
JUNK = ["cache parser rankers " * 30, "a,b,c\n1,2,3\n4,5,6\n", "2024-01-01 10:00:00 INFO store hit=3\n" * 9, "%$# &*( )!@ ^^ {} []\n" * 5, None, " \n", "the cache is stale and it is old " * 30]


@pytest.mark.parametrize("lang", PROSE)
def test_prose_of_any_language_runs(lang):
    assert textstats.running_share(PROSE[lang]) > 0.6


def test_batches_and_single_texts_have_the_same_figures():
    texts = [*PROSE.values(), *JUNK, "", "x", "`a b` and it is so\n\n- one\n- two"]
    whole, _ = textstats.figures(texts)
    assert whole == [textstats.figures([t])[0][0] for t in texts]
    assert textstats.running_shares(texts) == [w[-1] for w in whole]


def test_scores_decide_and_rare_languages_stay(spark):
    r = random.Random(3)
    words = "it is not what we were told to do when the old parser of the tree had been put in its place by a team that knew how to run all of it".split()
    good = [" ".join(r.choice(words) for _ in range(r.randrange(30, 90))).capitalize() + "." for _ in range(120)]
    bad = ["\n".join(f"{r.randrange(10**6)},{r.randrange(10**6)},{r.random():.4f}" for _ in range(r.randrange(8, 20))) for _ in range(40)]
    rows = [(i, t, "en") for i, t in enumerate(good + bad)] + [(1000 + i, t, l) for i, (l, t) in enumerate(PROSE.items())] + [(2000, None, "en"), (2001, " ", None)]
    labels = spark.createDataFrame([(i, "prose" if i < 120 else "not_prose", "a") for i in range(0, 160, 3)] + [(0, "not_prose", "b")], "doc_id BIGINT, label STRING, annotator STRING")
    documents = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    got = quality.judged(documents, labels).toPandas().set_index("doc_id").sort_index()
    assert set(got.index[got.not_prose]) == {*range(120, 160), 2000, 2001}
    assert (got.decided_by == "score").mean() > 0.5
    assert quality.fit_weights(quality.tail_scores(quality.text_statistics(documents)), labels.limit(0)) == [quality.PRIOR_CONSTANT, *[quality.PRIOR] * len(quality.SIDES)]


@pytest.mark.parametrize("values", [[[1, 1], [1, 1], [1, 2]], [[0, 1, 1], [1], [1, 1, 3]], [[5], [5], [5]], [[1, 2], [3, 4]], [[1, 1, 2], [2, 2], [2, 3], [3]]])
def test_offsets_of_partitions_with_ties_across_them(values):
    every = [v for part in values for v in part]
    parts = [{"n": len(p), "lo": p[0], "hi": p[-1], "c_lo": p.count(p[0]), "c_hi": p.count(p[-1])} for p in values]
    before = 0
    for part, (offset, less, least) in zip(values, quality._offsets(parts)):
        assert (offset, less, least) == (before, sum(v < part[0] for v in every), sum(v <= part[-1] for v in every))
        before += len(part)
