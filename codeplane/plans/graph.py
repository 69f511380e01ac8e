"""Graph queries bound to the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import extract as B
from ..operators import graphs as G
from ..sources.chunks import clean_chunks, files
from .common import CC
from .registry import query


def _tree(t):
    n = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    s = t("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("child"), F.concat(F.lit("n"), "s_nationkey").alias("parent"))
    c = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    return n.unionAll(s).unionAll(c)


_TREE = "tr AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"


@query("h3_ancestors", f"WITH RECURSIVE {_TREE}, up AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM tr UNION ALL SELECT u.node, t.parent, u.depth + 1 FROM up u JOIN tr t ON u.ancestor = t.child) SELECT node, ancestor, depth FROM up")
def h3(t):
    return G.ancestors(_tree(t))


@query("h4_descendants", f"WITH RECURSIVE {_TREE}, down AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth FROM region UNION ALL SELECT d.root, t.child, d.depth + 1 FROM down d JOIN tr t ON d.node = t.parent) SELECT root, node, depth FROM down WHERE depth > 0")
def h4(t):
    return G.descendants(_tree(t), t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("root")))


_NE = "e AS (SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst FROM nation UNION SELECT n_nationkey, (n_nationkey * 3 + 1) % 25 FROM nation)"


def _edges(t):
    n = F.col("n_nationkey")
    return t("nation").select(n.alias("src"), ((n * 7 + 3) % 25).alias("dst")).union(t("nation").select(n, (n * 3 + 1) % 25)).distinct()


def _import_edges(t):
    c = clean_chunks(t("chunks"))
    key = F.concat_ws(":", "repo_id", F.regexp_replace("chunk_id", r"::\d+$", ""))
    return c.where("imports IS NOT NULL").select(key.alias("src"), F.col("repo_id").alias("r"), F.explode(F.map_keys("imports")).alias("d")).select("src", F.concat_ws(":", "r", F.regexp_replace("d", r"::\d+$", "")).alias("dst"))


_IE = f"{CC}, e AS (SELECT DISTINCT concat(repo_id, ':', regexp_replace(chunk_id, '::\\d+$', '')) AS src, concat(repo_id, ':', regexp_replace(unnest(map_keys(imports)), '::\\d+$', '')) AS dst FROM cc)"
_P = f"{_IE}, p AS (SELECT src, dst, [src, dst] AS path, 1 AS length FROM e WHERE src <> dst UNION ALL SELECT p.src, e.dst, list_append(p.path, e.dst), p.length + 1 FROM p JOIN e ON p.dst = e.src WHERE p.length < 4 AND NOT list_contains(p.path, e.dst))"


@query("h6_simple_paths", f"WITH RECURSIVE {_P} SELECT src, dst, path, length FROM p WHERE src < dst")
def h6(t):
    """Paths of up to 4 imports between files."""
    return G.simple_paths(_import_edges(t), 4)


@query("g7_longest_paths", f"WITH RECURSIVE {_P} SELECT src, dst, path, length FROM p WHERE src < dst ORDER BY length DESC, path LIMIT 10")
def g7(t):
    return G.longest_paths(_import_edges(t), 4, 10)


@query("h7_paths_through", f"WITH RECURSIVE {_P}, hub AS (SELECT dst FROM e GROUP BY 1 ORDER BY count(*) DESC, dst LIMIT 1) SELECT src, p.dst, path FROM p, hub WHERE src < p.dst AND list_contains(path, hub.dst)")
def h7(t):
    """Paths through the file that is imported most."""
    e = _import_edges(t).distinct()
    hub = e.groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").limit(1).select(F.col("dst").alias("hub"))
    return G.simple_paths(e, 4).join(F.broadcast(hub), F.array_contains("path", F.col("hub"))).select("src", "dst", "path")


@query("h1_communities")
def h1(t):
    return G.communities(_import_edges(t))


@query("h1_codelength")
def h1b(t):
    e = _import_edges(t)
    return G.codelength(e, G.communities(e))


@query("h5_nearest_class")
def h5(t):
    return G.nearest_of_type(B.blocks(files(t("chunks"), ("py",))), ["class"])


@query("h8_edge_series")
def h8(t):
    """Chains of steps from one kind of event to the next, per user."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    steps = t("events").select("user_id", F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst")).where("dst IS NOT NULL")
    return G.edge_series(steps.distinct(), "user_id")


@query("h13_path_trie", f"""WITH {CC}, p AS (SELECT DISTINCT repo_id, string_split(file_path, '/') AS parts FROM cc), x AS (SELECT repo_id, parts, unnest(range(1, len(parts) + 1)) AS n FROM p)
 SELECT repo_id, array_to_string(parts[1:n], '/') AS prefix, n AS depth, bool_or(n = len(parts)) AS is_leaf FROM x GROUP BY 1, 2, 3""")
def h13(t):
    return G.prefixes(clean_chunks(t("chunks")).select("repo_id", "file_path").distinct(), "repo_id", "file_path")


@query("h15_removed_nodes", f"WITH {_NE} SELECT src, dst FROM e WHERE src % 5 <> 0 AND dst % 5 <> 0")
def h15(t):
    e = _edges(t)
    nodes = t("nation").select(F.col("n_nationkey").alias("node"))
    return G.without_nodes(nodes, e, nodes.where("node % 5 = 0"))[1].select("src", "dst")


@query("h16_rendered", f"WITH {_NE} SELECT src % 5 AS grp, string_agg(src || ' -> ' || dst, chr(10) ORDER BY src, dst) AS text FROM e GROUP BY 1")
def h16(t):
    return G.rendered(_edges(t).withColumn("grp", F.col("src") % 5), "grp")
