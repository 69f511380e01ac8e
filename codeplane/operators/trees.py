"""Block trees as tables: lookups, predicates, references by name, edits and acceptance of updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .extract import blocks

FILE = ["repo_id", "file_path"]


def edges_of(edges: DataFrame, kinds: list[str], src: Column | None = None, dst: Column | None = None) -> DataFrame:
    """Edges of some kinds, from and to given nodes where these are given (C18, C28). edges(src, dst, kind)."""
    out = edges.where(F.col("kind").isin(kinds))
    if src is not None:
        out = out.where(F.col("src") == src)
    return out if dst is None else out.where(F.col("dst") == dst)


def has_any_span(spans: Column, wanted: Column) -> Column:
    """Whether a block holds one of the spans (C26); null arrays hold none."""
    return F.coalesce(F.arrays_overlap(spans, wanted), F.lit(False))


def first_of_type(rows: DataFrame, kind: Column, order: list[str], group: list[str] = FILE) -> DataFrame:
    """The first row of a kind per group in pre-order (C32); groups without one have none."""
    rest = [c for c in rows.columns if c not in group]
    return rows.where(kind).groupBy(*group).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*group, "r.*")


def complete_files(lines: DataFrame) -> DataFrame:
    """Per file whether no line of it stands for code that was left out (C33, C34). lines(repo_id, file_path, line)."""
    text = F.trim("line")
    gap = F.col("line").rlike(r"^\s*(#|//)") & X.is_placeholder_comment(F.regexp_replace(text, "^//", "#"))
    return lines.groupBy(*FILE).agg(F.count_if(gap).alias("n_gaps"), (F.count_if(gap) == 0).alias("is_complete"))


def by_path(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """Blocks with the wanted paths of their files (H11). wanted(repo_id, file_path, path)."""
    return tree.join(wanted.select(*FILE, "path").distinct(), [*FILE, "path"], "left_semi")


def _suffixes(path: Column) -> Column:
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "."))


def found_references(tree: DataFrame, refs: DataFrame) -> DataFrame:
    """Where a dotted name that a block refers to is found, looking outward through the block and its parents.

    tree(repo_id, file_path, block, parent, type, path, relationships), refs(repo_id, file_path, block, ref). At each level
    the children are looked at in order: an import one of whose names ends in the reference, or a child whose path does.
    scope is 'external' for an import, else class, global or local by the type of the block whose child it is.
    Every suffix of a path is a key, so the match is an equi-join within the file, and the chain of parents of a block is
    the prefixes of its path; references without a match are no rows.
    """
    own = tree.select(*FILE, "block", "path", "type")
    child = tree.where("block > 0").select(*FILE, F.col("parent").alias("holder"), F.col("block").alias("child"), "path", "type", "relationships")
    names = child.select(*FILE, "holder", "child", F.explode(F.flatten(F.array(
        F.transform(F.filter("relationships", lambda r: (r["kind"] == "import") & (F.col("type") == "import")), lambda r: F.struct(F.lit(0).alias("rank"), r["target"].alias("target"))),
        F.array(F.struct(F.lit(1).alias("rank"), F.col("path").alias("target"))),
    ))).alias("n")).select(*FILE, "holder", "child", "n.rank", "n.target")
    keys = names.select(*FILE, "holder", "child", "rank", "target", F.explode(_suffixes(F.col("target"))).alias("ref")).distinct()
    parts = F.split("path", r"\.")
    up = own.select(*FILE, "block", F.explode(F.transform(F.sequence(F.lit(0), F.when(F.col("path") == "", 0).otherwise(F.size(parts))), lambda n: F.struct(n.alias("level"), F.array_join(F.slice(parts, 1, n), ".").alias("holder_path")))).alias("u"))
    up = up.select(*FILE, "block", "u.level", "u.holder_path").join(own.select(*FILE, F.col("block").alias("holder"), F.col("path").alias("holder_path"), F.col("type").alias("holder_type")), [*FILE, "holder_path"])
    hit = refs.select(*FILE, "block", "ref").distinct().join(up, [*FILE, "block"]).join(keys, [*FILE, "holder", "ref"])
    best = hit.groupBy(*FILE, "block", "ref").agg(F.min_by(F.struct("holder_type", "rank", "target"), F.struct((-F.col("level")).alias("l"), "child", "rank", "target")).alias("b"))
    scope = F.when(F.col("b.rank") == 0, "external").when(F.col("b.holder_type") == "class", "class").when(F.col("b.holder_type") == "module", "global").otherwise("local")
    return best.select(*FILE, "block", "ref", scope.alias("scope"), F.col("b.target").alias("target"))


def path_tree(paths: DataFrame, group: list[str], path: str = "path") -> DataFrame:
    """The tree of dotted paths: every prefix with its depth, its children and whether a path ends there."""
    parts = F.split(path, r"\.")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), ".").alias("prefix"), n.alias("depth"), (n == F.size(parts)).alias("show"), F.get(parts, n).alias("next")))
    return paths.select(*group, F.explode(steps).alias("x")).groupBy(*group, "x.prefix", "x.depth").agg(F.bool_or("x.show").alias("show"), F.count_distinct("x.next").alias("n_children"))


# ------------------------------------------------------------------------------- edits (I16)
def inserted(children: DataFrame, new: DataFrame) -> DataFrame:
    """children(parent, pos, child) with new(parent, pos, child) put in before the children of those places; places count from 0.

    Places beyond the end append; several for one place keep their order by child.
    """
    both = children.select("parent", F.col("pos").cast("double").alias("p"), F.lit(1).alias("old"), "child").unionByName(new.select("parent", F.col("pos").cast("double").alias("p"), F.lit(0).alias("old"), "child"))
    return _placed(both)


def _placed(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("parent").orderBy("p", "old", "child")
    return rows.withColumn("pos", (F.row_number().over(w) - 1).cast("int")).select("parent", "pos", "child")


def removed(children: DataFrame, gone: DataFrame) -> DataFrame:
    """children without gone(parent, child), the places of the rest closed up."""
    return _placed(children.join(gone.select("parent", "child").distinct(), ["parent", "child"], "left_anti").select("parent", F.col("pos").cast("double").alias("p"), F.lit(1).alias("old"), "child"))


def replaced(children: DataFrame, swaps: DataFrame) -> DataFrame:
    """children with swaps(parent, child, new) made in place; unknown children change nothing."""
    return children.join(swaps.select("parent", "child", "new"), ["parent", "child"], "left").select("parent", "pos", F.coalesce("new", "child").alias("child"))


def indented(text: Column, width: int) -> Column:
    """The text with every line that is not blank moved by so many blanks; negative widths take them away where they are."""
    if width >= 0:
        return F.regexp_replace(text, r"(?m)^(?=.*\S)", " " * width)
    return F.regexp_replace(text, rf"(?m)^ {{1,{-width}}}", "")


# --------------------------------------------------------------------- acceptance of updates
def accepted_updates(old: DataFrame, new: DataFrame) -> DataFrame:
    """Whether each new text of a file would be taken (I15): repo_id, file_path, changed, accepted, reason, new_blocks.

    Files(repo_id, file_path, content). A text is refused if it does not parse, defines a name twice, or has a gap for
    left-out code where the old text had none; an unchanged text is not taken either. new_blocks are the paths that came.
    """
    o, n = blocks(old), blocks(new)
    state = n.groupBy(*FILE).agg(F.count_if(F.col("type") == "ERROR").alias("errors"), F.count_if((F.col("duplicate") == 1) & (F.col("type") != "ERROR")).alias("twice"), F.collect_set(F.when(F.col("path") != "", F.col("path"))).alias("paths"))
    before = o.groupBy(*FILE).agg(F.collect_set(F.when(F.col("path") != "", F.col("path"))).alias("old_paths"))
    gap = lambda c: F.coalesce(c.rlike(r"(?mi)^\s*#.*(?:^\s*# \.\.\.|rest of the code|existing code|other code)|(?m)^\s*# \.\.\."), F.lit(False))
    texts = new.select(*FILE, F.col("content").alias("__new")).join(old.select(*FILE, F.col("content").alias("__old")), FILE, "left")
    x = texts.join(state, FILE).join(before, FILE, "left")
    changed = ~F.col("__new").eqNullSafe(F.col("__old"))
    reason = F.when(~changed, "unchanged").when(F.col("errors") > 0, "invalid code").when(F.col("twice") > 0, "a name is defined twice").when(gap(F.col("__new")) & ~gap(F.col("__old")), "code is left out")
    return x.select(*FILE, changed.alias("changed"), reason.isNull().alias("accepted"), reason.alias("reason"), F.sort_array(F.array_except("paths", F.coalesce("old_paths", F.array().cast("array<string>")))).alias("new_blocks"))
