"""Graphs as node and edge tables: recursion, paths, communities, mutation, rendering (H family)."""

from __future__ import annotations

import math
import tempfile
from functools import reduce
from itertools import count, groupby
from operator import itemgetter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def checkpointed(df: DataFrame) -> DataFrame:
    """Rows written once to the folder that the session's spark.checkpoint.dir names.

    Where none is set a temporary folder serves a local session; on a cluster, where executors would not share it, that is an error.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))
    return df.checkpoint(eager=True)


def _closure(start: DataFrame, step: DataFrame) -> DataFrame:
    """(a, b, depth): what is reached from start(a, b) by step(b, c), each pair once, at its least depth.

    Level by level; a level is written before the next one is made, and the loop ends with the first empty one,
    so neither depth nor size has a bound, and cycles end too.
    """
    step = checkpointed(step.select("b", "c").distinct())
    levels = [checkpointed(start.select("a", "b").distinct().withColumn("depth", F.lit(1)))]
    found = levels[0]
    for depth in count(2):
        front = levels[-1].select("a", "b").join(step, "b").select("a", F.col("c").alias("b")).distinct()
        front = checkpointed(front.join(found.select("a", "b"), ["a", "b"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.limit(1).count() == 0:
            return found
        levels.append(front)
        found = reduce(DataFrame.unionByName, levels)


def ancestors(tree: DataFrame) -> DataFrame:
    """(node, ancestor, depth) upwards from every node of tree(child, parent), each pair once (H3, H5)."""
    up = tree.select(F.col("child").alias("b"), F.col("parent").alias("c"))
    return _closure(up.select(F.col("b").alias("a"), F.col("c").alias("b")), up).select(F.col("a").alias("node"), F.col("b").alias("ancestor"), "depth")


def descendants(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth) downwards from given roots(root), each pair once."""
    down = tree.select(F.col("parent").alias("b"), F.col("child").alias("c"))
    start = down.join(roots.select(F.col("root").alias("b")).distinct(), "b", "left_semi").select(F.col("b").alias("a"), F.col("c").alias("b"))
    return _closure(start, down).select(F.col("a").alias("root"), F.col("b").alias("node"), "depth")


def simple_paths(edges: DataFrame, depth: int) -> DataFrame:
    """All simple paths of up to ``depth`` edges from a node to a greater one (H6): src, dst, path, length.

    edges(src, dst). Paths multiply with the depth, which is the caller's bound; every length is written before the next.
    """
    e = checkpointed(edges.select("src", "dst").where("src <> dst").distinct())
    levels = [e.select("src", "dst", F.array("src", "dst").alias("path"), F.lit(1).alias("length"))]
    for length in range(2, depth + 1):
        longer = levels[-1].select("src", F.col("dst").alias("via"), "path").join(e.select(F.col("src").alias("via"), "dst"), "via").where(~F.array_contains("path", F.col("dst")))
        levels.append(checkpointed(longer.select("src", "dst", F.array_append("path", F.col("dst")).alias("path"), F.lit(length).alias("length"))))
    return reduce(DataFrame.unionByName, levels).where("src < dst")


def longest_paths(edges: DataFrame, depth: int, n: int = 10) -> DataFrame:
    """The n longest simple paths; ties go to the first nodes."""
    return simple_paths(edges, depth).orderBy(F.desc("length"), "path").limit(n)


def paths_through(paths: DataFrame, node) -> DataFrame:
    """Paths that hold a node (H7)."""
    return paths.where(F.array_contains("path", node))


def _plogp(c):
    return F.when(c > 0, c * F.log2(c)).otherwise(0.0)


def _length(modules: DataFrame) -> float:
    """The part of the map equation that depends on the partition; modules(p, q): their flow and what leaves them."""
    q, p = F.col("q"), F.col("p")
    r = modules.agg(F.sum(q).alias("q"), F.sum(_plogp(q)).alias("a"), F.sum(_plogp(q + p)).alias("b")).first()
    total = r["q"] or 0.0
    return (total * math.log2(total) if total > 0 else 0.0) - 2 * (r["a"] or 0.0) + (r["b"] or 0.0)


def _moved_nodes(nodes: DataFrame, links: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """Labels after nodes have moved to neighbouring modules as long as that shortens the map equation.

    nodes(node, p, out), links(src, dst, w) in both directions, labels(node, m). In each round every node finds its best
    move. By turns of a hash, modules give nodes or take them, so many join one module at once; a round that does
    not shorten the description is undone, and the next makes only the best of the moves that share a module.
    The loop ends when no such move gains.
    """
    state = checkpointed(labels.join(nodes, "node"))
    before, length, strict, by_best = state, None, False, False
    for n in count():
        own = state.select("node", "m")
        across = links.join(own.select(F.col("node").alias("src"), F.col("m").alias("a")), "src").join(own.select(F.col("node").alias("dst"), F.col("m").alias("b")), "dst")
        near = checkpointed(across.groupBy("src", "a", "b").agg(F.sum("w").alias("w")))
        inner = near.where("a = b").groupBy("a").agg(F.sum("w").alias("within"))
        flows = state.groupBy(F.col("m").alias("a")).agg(F.sum("p").alias("p"), F.sum("out").alias("out"))
        modules = checkpointed(flows.join(inner, "a", "left").select("a", "p", F.greatest(F.col("out") - F.coalesce("within", F.lit(0.0)), F.lit(0.0)).alias("q")))
        now = _length(modules)
        if length is not None and now > length - least:
            if by_best:
                return before.select("node", "m")
            state, strict = before, True
            length = None
            continue
        length, before = now, state
        total = modules.agg(F.sum("q")).first()[0] or 0.0
        mine = near.where("a = b").select("src", F.col("w").alias("wa"))
        x = near.where("a <> b").join(mine, "src", "left").fillna(0.0, ["wa"]).join(nodes.select(F.col("node").alias("src"), F.col("p").alias("pi"), "out"), "src")
        x = x.join(modules.select("a", F.col("p").alias("pa"), F.col("q").alias("qa")), "a").join(modules.select(F.col("a").alias("b"), F.col("p").alias("pb"), F.col("q").alias("qb")), "b")
        qa, qb = F.greatest(F.col("qa") - F.col("out") + 2 * F.col("wa"), F.lit(0.0)), F.greatest(F.col("qb") + F.col("out") - 2 * F.col("w"), F.lit(0.0))
        pa, pb = F.greatest(F.col("pa") - F.col("pi"), F.lit(0.0)), F.col("pb") + F.col("pi")
        change = lambda f: f(qa, pa) + f(qb, pb) - f(F.col("qa"), F.col("pa")) - f(F.col("qb"), F.col("pb"))
        gain = _plogp(F.lit(total) + change(lambda q, p: q)) - _plogp(F.lit(total)) - 2 * change(lambda q, p: _plogp(q)) + change(lambda q, p: _plogp(q + p))
        x = x.withColumn("gain", gain).where(F.col("gain") < -least)
        if not strict:
            turn = lambda c: F.pmod(F.xxhash64(c, F.lit(n)), F.lit(2))
            made = checkpointed(x.where((turn("a") == 0) & (turn("b") == 1)).groupBy("src").agg(F.min_by("b", F.struct("gain", "b")).alias("to")).select(F.col("src").alias("node"), "to"))
        else:
            best = checkpointed(x.groupBy("src", "a").agg(F.min(F.struct("gain", "b")).alias("x")).select(F.col("src").alias("node"), "a", "x.b", F.struct("x.gain", F.col("src").alias("node")).alias("rank")))
            touched = best.select(F.col("a").alias("m"), "rank").unionAll(best.select(F.col("b").alias("m"), "rank")).groupBy("m").agg(F.min("rank").alias("first"))
            made = best.join(touched.select(F.col("m").alias("a"), F.col("first").alias("fa")), "a").join(touched.select(F.col("m").alias("b"), F.col("first").alias("fb")), "b").where("rank = fa AND rank = fb")
            made = checkpointed(made.select("node", F.col("b").alias("to")))
        if made.limit(1).count() == 0:
            if strict:
                return state.select("node", "m")
            strict, length = True, None
            continue
        strict, by_best = False, strict
        state = checkpointed(state.join(made, "node", "left").select("node", F.coalesce("to", "m").alias("m"), "p", "out"))


def _modules(nodes: DataFrame, links: DataFrame, least: float) -> DataFrame:
    """(node, m): moves of nodes, then of whole modules, until nothing gains; for graphs of any size."""
    labels = nodes.select("node", F.col("node").alias("m"))
    n = nodes.count()
    while n:
        moved = checkpointed(_moved_nodes(nodes, links, nodes.select("node", F.col("node").alias("m")), least))
        left = moved.select("m").distinct().count()
        if left == n:
            break
        n = left
        labels = checkpointed(labels.join(moved.select(F.col("node").alias("m"), F.col("m").alias("up")), "m").select("node", F.col("up").alias("m")))
        pairs = links.join(moved.select(F.col("node").alias("src"), F.col("m").alias("a")), "src").join(moved.select(F.col("node").alias("dst"), F.col("m").alias("b")), "dst")
        links = checkpointed(pairs.where("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))
        flow = nodes.join(moved, "node").groupBy(F.col("m").alias("node")).agg(F.sum("p").alias("p"))
        nodes = checkpointed(flow.join(links.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("out")), "node", "left").fillna(0.0, ["out"]))
    return labels


def _sweep(near: list[dict[int, float]], flow: list[float], label: list[int], outside: float, least: float) -> bool:
    """Moves nodes between neighbouring modules, one at a time, while that shortens the map equation; whether any moved."""
    plogp = lambda x: x * math.log2(x) if x > 0 else 0.0
    n = len(near)
    out = [sum(x.values()) for x in near]
    p, q = [0.0] * n, [0.0] * n
    for i in range(n):
        p[label[i]] += flow[i]
        q[label[i]] += sum(w for j, w in near[i].items() if label[j] != label[i])
    total = sum(q) + outside
    moved, changed = True, False
    while moved:
        moved = False
        for i in range(n):
            a = label[i]
            to: dict[int, float] = {}
            for j, w in near[i].items():
                to[label[j]] = to.get(label[j], 0.0) + w
            wa = to.pop(a, 0.0)
            qa = max(0.0, q[a] - out[i] + 2 * wa)
            best, chosen = -least, None
            for b, wb in sorted(to.items()):
                qb = max(0.0, q[b] + out[i] - 2 * wb)
                gain = plogp(total + qa + qb - q[a] - q[b]) - plogp(total) - 2 * (plogp(qa) + plogp(qb) - plogp(q[a]) - plogp(q[b]))
                gain += plogp(qa + p[a] - flow[i]) + plogp(qb + p[b] + flow[i]) - plogp(q[a] + p[a]) - plogp(q[b] + p[b])
                if gain < best:
                    best, chosen = gain, (b, qb)
            if chosen:
                b, qb = chosen
                total += qa + qb - q[a] - q[b]
                q[a], q[b], label[i] = qa, qb, b
                p[a] -= flow[i]
                p[b] += flow[i]
                moved = changed = True
    return changed


def small_modules(src: list, dst: list, weight: list, least: float = 1e-9, outside: float = 0.0) -> tuple[dict, float, float]:
    """(node -> module, what leaves the modules, the sum of their terms) of a graph in memory, by the same search, one move at a time.

    Links in both directions; outside is what leaves the modules of the rest of the graph. Nodes and whole modules move
    by turns until neither gains.
    """
    names = sorted(set(src))
    place = {v: i for i, v in enumerate(names)}
    near: list[dict[int, float]] = [{} for _ in names]
    for a, b, w in zip(src, dst, weight):
        near[place[a]][place[b]] = near[place[a]].get(place[b], 0.0) + w
    flow = [sum(x.values()) for x in near]
    label = list(range(len(names)))
    while True:
        changed = _sweep(near, flow, label, outside, least)
        number = {m: k for k, m in enumerate(sorted(set(label)))}
        label = [number[m] for m in label]
        wider: list[dict[int, float]] = [{} for _ in number]
        flows = [0.0] * len(number)
        for i, x in enumerate(near):
            a = label[i]
            flows[a] += flow[i]
            for j, w in x.items():
                if label[j] != a:
                    wider[a][label[j]] = wider[a].get(label[j], 0.0) + w
        up = list(range(len(number)))
        if not _sweep(wider, flows, up, outside, least) and not changed:
            leaves = [sum(x.values()) for x in wider]
            plogp = lambda x: x * math.log2(x) if x > 0 else 0.0
            return {v: label[i] for v, i in place.items()}, sum(leaves), sum(plogp(q + p) - 2 * plogp(q) for q, p in zip(leaves, flows))
        label = [up[m] for m in label]


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that is linked to it; links(src, dst) in both directions.

    Labels pass along links and then jump to their own label, so the rounds grow with the logarithm of the paths' lengths.
    """
    near = checkpointed(links.select("src", "dst").distinct())
    labels = checkpointed(near.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    while True:
        passed = near.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        x = labels.join(passed, "node").select("node", "component", F.least("component", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("component").alias("far"))
        x = checkpointed(x.join(jump, "new", "left").select("node", F.col("component").alias("old"), F.least("new", "far").alias("component")))
        labels = x.select("node", "component")
        if x.where("old <> component").limit(1).count() == 0:
            return labels


#: Links of a connected component up to which it is searched in one task; larger ones are searched by all.
SMALL = 200_000
#: Bits that another pass over the components must gain to be followed by one more.
PASS = 1e-2


def communities(edges: DataFrame, least: float = 1e-9, small: int = SMALL) -> DataFrame:
    """(node, community) by greedy search on the two-level map equation (H1); a community is named after its least node.

    Parallel edges count as often as they occur; isolated nodes have no community.  Nodes begin alone and move
    where that shortens the description most; then whole modules move as nodes do, until nothing gains.  Connected
    components of up to ``small`` links are searched each in a task, and again with what leaves the others' modules
    until a pass gains less than PASS; larger ones by rounds of joins and aggregations over all tasks.
    """
    both = edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst")
    links = checkpointed(both.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w")))
    total = links.agg(F.sum("w")).first()[0] or 1.0
    links = links.withColumn("w", F.col("w") / total)
    parts = components(links)
    placed = checkpointed(links.join(parts.withColumnRenamed("node", "src"), "src"))
    sizes = placed.groupBy("component").agg(F.count("*").alias("n"))
    kind = dict(links.dtypes)["src"]

    def search(frame):
        import pandas as pd

        rows = []
        every = sorted(zip(frame["component"].tolist(), frame["src"].tolist(), frame["dst"].tolist(), frame["w"].tolist(), frame["outside"].tolist()))
        for c, part in groupby(every, key=itemgetter(0)):
            _, src, dst, w, outside = zip(*part)
            found, q, terms = small_modules(src, dst, w, least, outside[0])
            first: dict = {}
            for v, m in found.items():
                first[m] = min(first.get(m, v), v)
            rows += [(v, first[m], c, q, terms) for v, m in found.items()]
        return pd.DataFrame(rows, columns=["node", "community", "component", "q", "terms"])

    # components share a task up to about as many links as one of them may have
    tasks = max(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-links.count() // small) if small else 1)
    mine = placed.join(sizes.where(F.col("n") <= small), "component", "left_semi").select("component", "src", "dst", "w")
    mine = checkpointed(mine)
    few, length = None, None
    while True:
        # what leaves the modules of all other components weighs on a component's own search
        if few is None:
            around = mine.withColumn("outside", F.lit(0.0))
        else:
            own = few.groupBy("component").agg(F.first("q").alias("q"))
            every = own.agg(F.sum("q").alias("every"))
            around = mine.join(own, "component").join(F.broadcast(every)).withColumn("outside", F.greatest(F.col("every") - F.col("q"), F.lit(0.0))).drop("q", "every")
        found = checkpointed(around.groupBy(F.pmod(F.xxhash64("component"), F.lit(tasks))).applyInPandas(search, f"node {kind}, community {kind}, component {kind}, q DOUBLE, terms DOUBLE"))
        sums = found.groupBy("component").agg(F.first("q").alias("q"), F.first("terms").alias("terms")).agg(F.sum("q").alias("q"), F.sum("terms").alias("terms")).first()
        now = None if sums["q"] is None else (sums["q"] * math.log2(sums["q"]) if sums["q"] > 0 else 0.0) + sums["terms"]
        gained = None if length is None or now is None else length - now
        if few is None or gained is not None and gained > 0:
            few, length = found, now
        if now is None or gained is not None and gained < PASS:
            break
    few = few.select("node", "community")
    large = sizes.where(F.col("n") > small)
    if large.limit(1).count() == 0:
        return few
    rest = checkpointed(placed.join(large, "component", "left_semi").select("src", "dst", "w"))
    nodes = checkpointed(rest.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("p"), F.sum("w").alias("out")))
    labels = _modules(nodes, rest, least)
    named = labels.groupBy("m").agg(F.min("node").alias("community"))
    return few.unionByName(labels.join(named, "m").select("node", "community"))


def codelength(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The two-level map equation of a partition, undirected, in bits: less is better (H1)."""
    links = edges.select("src", "dst").where("src <> dst")
    both = links.unionAll(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    l1, l2 = labels.select(F.col("node").alias("src"), F.col("community").alias("a")), labels.select(F.col("node").alias("dst"), F.col("community").alias("b"))
    x = both.join(l1, "src").join(l2, "dst")
    total = F.broadcast(x.agg(F.count("*").alias("total")))
    node = x.groupBy("src").agg(F.count("*").alias("k")).join(total).withColumn("p", F.col("k") / F.col("total"))
    nodes = node.agg(F.sum(_plogp(F.col("p"))).alias("node_term"))
    module = x.groupBy("a").agg(F.count("*").alias("k"), F.count_if(F.col("a") != F.col("b")).alias("out")).join(total)
    q, p = F.col("out") / F.col("total"), F.col("k") / F.col("total")
    mods = module.agg(F.sum(q).alias("q"), F.sum(_plogp(q)).alias("q_term"), F.sum(_plogp(q + p)).alias("qp_term"), F.count("*").alias("n_communities"))
    return mods.join(F.broadcast(nodes)).select("n_communities", (_plogp(F.col("q")) - 2 * F.col("q_term") - F.col("node_term") + F.col("qp_term")).alias("codelength"))


def edge_series(edges: DataFrame, group: str) -> DataFrame:
    """Maximal chains of edges per group, by depth-first visits from nodes without a way in; each edge is in one (H8).

    edges(group, src, dst); a fold over the edges of one group.
    """
    kinds = dict(edges.dtypes)

    def run(frame):
        import pandas as pd

        out: dict = {}
        for s, d in sorted(set(zip(frame["src"], frame["dst"]))):
            out.setdefault(s, []).append(d)
        targets = {d for ds in out.values() for d in ds}
        seen, rows = set(), []
        for start in sorted(out, key=lambda n: (n in targets, n)):
            while True:
                chain, node = [start], start
                while nxt := [d for d in out.get(node, []) if (node, d) not in seen]:
                    seen.add((node, nxt[0]))
                    node = nxt[0]
                    chain.append(node)
                if len(chain) < 2:
                    break
                rows.append((frame[group].iat[0], len(rows) + 1, chain))
        return pd.DataFrame(rows, columns=[group, "series", "chain"])

    return edges.select(group, "src", "dst").groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, series INT, chain ARRAY<{kinds['src']}>")


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame, key: str = "node") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after the removal of nodes, whose edges go with them."""
    g = gone.select(key).distinct()
    left = edges.join(g.withColumnRenamed(key, "src"), "src", "left_anti").join(g.withColumnRenamed(key, "dst"), "dst", "left_anti")
    return nodes.join(g, key, "left_anti"), left


def rendered(edges: DataFrame, group: str) -> DataFrame:
    """One text per group with a line 'src -> dst' per edge, in order."""
    line = F.concat_ws(" -> ", F.col("src").cast("string"), F.col("dst").cast("string"))
    return edges.groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("src", "dst", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


def prefixes(paths: DataFrame, group: str, path: str) -> DataFrame:
    """The trie of the paths of a group: every prefix with its depth and whether it is a whole path."""
    p = F.split(path, "/")
    x = paths.select(group, F.explode(F.transform(F.sequence(F.lit(1), F.size(p)), lambda n: F.struct(F.array_join(F.slice(p, 1, n), "/").alias("prefix"), n.alias("depth"), (n == F.size(p)).alias("leaf")))).alias("x"))
    return x.groupBy(group, "x.prefix", "x.depth").agg(F.bool_or("x.leaf").alias("is_leaf"))


def nearest_of_type(blocks: DataFrame, kinds: list[str]) -> DataFrame:
    """Each block with the path of its nearest ancestor of the given types, by its path's prefixes."""
    w = ["repo_id", "file_path"]
    p = F.split("path", r"\.")
    b = blocks.where("path <> ''").select(*w, "block", "path", F.explode(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1)))).alias("n"))
    b = b.withColumn("up", F.array_join(F.slice(F.split("path", r"\."), 1, F.col("n")), "."))
    a = blocks.where(F.col("type").isin(kinds)).select(*w, F.col("path").alias("up"), F.lit(True).alias("hit")).distinct()
    return b.where("up <> path").join(a, [*w, "up"]).groupBy(*w, "block", "path").agg(F.max_by("up", "n").alias("ancestor"))
