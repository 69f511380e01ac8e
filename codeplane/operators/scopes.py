"""Scopes, definitions, references and imports of files, and the graph between chunks.

Tables carry (repo_id, file_path); joins are on the file first, so a range condition only meets rows of one file.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE = ["repo_id", "file_path"]


class _Ends:
    """The least key among the intervals put in so far that end at a line or behind it; put and find take log n steps."""

    def __init__(self, ends: list[int]):
        self.ends = sorted(set(ends))
        self.best: list = [None] * (len(self.ends) + 1)

    def put(self, end: int, key: tuple):
        i = len(self.ends) - bisect_left(self.ends, end)
        while i < len(self.best):
            if self.best[i] is None or key < self.best[i]:
                self.best[i] = key
            i += i & -i

    def find(self, end: int) -> tuple | None:
        i, found = len(self.ends) - bisect_left(self.ends, end), None
        while i > 0:
            if self.best[i] is not None and (found is None or self.best[i] < found):
                found = self.best[i]
            i -= i & -i
        return found


def _enclosing(ranges: list[tuple[int, int]], scopes: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(s, e, id) of ranges and the smallest of the scopes (start, end, id) that holds each, the first id on ties; one sweep by start."""
    ends = _Ends([e for _, e, _ in scopes])
    todo = sorted(scopes)
    at, out = 0, []
    for s, e in sorted(ranges):
        while at < len(todo) and todo[at][0] <= s:
            a, b, i = todo[at]
            ends.put(b, (b - a, i))
            at += 1
        if found := ends.find(e):
            out.append((s, e, found[1]))
    return out


def _parents(scopes: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(id, parent) of scopes (id, start, end) in order of id: the smallest of those before it that holds it, the last of these on ties."""
    ends = _Ends([e for _, _, e in scopes])
    out, todo = [], sorted(scopes)
    if any(a[1] > b[1] for a, b in zip(todo, todo[1:])):  # ids that do not follow the text, as captures' do
        for n, (i, s, e) in enumerate(todo):
            out.append((i, -min(((b - a, -p) for p, a, b in todo[:n] if a <= s and e <= b), default=(0, 0))[1]))
        return out
    for i, s, e in todo:
        # a scope before this one begins on its line or before it
        found = ends.find(e)
        out.append((i, -found[1] if found else 0))
        ends.put(e, (e - s, -i))
    return out


def _per_file(rows: DataFrame, each, file: list[str], names: list[str], types: list[str]) -> DataFrame:
    """Rows that each(*lists) makes of the lists of every file."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = dict(rows.dtypes)
    ddl = ", ".join([*(f"{c} {kinds[c]}" for c in file), *(f"{n} {t}" for n, t in zip(names, types))])
    arrow = to_arrow_schema(StructType.fromDDL(ddl))
    k = len(file)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                lists = [[tuple(x.values()) for x in r] for r in row[k:]]
                out.extend((*row[:k], *x) for x in each(*lists))
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(arrow.names, map(list, zip(*out)))), schema=arrow)

    return rows.mapInArrow(run, ddl)


def smallest_enclosing(ranges: DataFrame, scopes: DataFrame, file: list[str] = FILE) -> DataFrame:
    """Each range with the smallest scope that holds it, the first id on ties; 0, the file, if none does.

    ranges(file.., s, e, ..), scopes(file.., scope_id, start_row, end_row). The distinct lines of a file's ranges and its scopes
    meet in one sweep, so the time grows with n log n of the file, not with their product.
    """
    r = ranges.select(*file, "s", "e").where("s IS NOT NULL AND e IS NOT NULL").groupBy(*file).agg(F.collect_set(F.struct("s", "e")).alias("r"))
    sc = scopes.where("start_row IS NOT NULL AND end_row IS NOT NULL").groupBy(*file).agg(F.collect_list(F.struct("start_row", "end_row", "scope_id")).alias("sc"))
    kinds, rk = dict(scopes.dtypes), dict(ranges.dtypes)
    best = _per_file(r.join(sc, file).select(*file, "r", "sc"), _enclosing, file, ["s", "e", "scope_id"], [rk["s"], rk["e"], kinds["scope_id"]])
    return ranges.join(best, [*file, "s", "e"], "left").withColumn("scope_id", F.coalesce("scope_id", F.lit(0)))


def scope_table(caps: DataFrame) -> DataFrame:
    """Scopes with their parents, 0 being the file (N2): the smallest of the scopes before it that holds it; one sweep per file."""
    s = caps.where("kind = 'scope'").select(*FILE, F.col("ord").alias("scope_id"), "sub", "name", "start_row", "end_row")
    lists = s.groupBy(*FILE).agg(F.collect_list(F.struct("scope_id", "start_row", "end_row")).alias("s"))
    up = _per_file(lists, _parents, FILE, ["scope_id", "parent_id"], ["int", "int"])
    return s.join(up, [*FILE, "scope_id"], "left").withColumn("parent_id", F.coalesce("parent_id", F.lit(0)))


def placed(caps: DataFrame, scopes: DataFrame) -> DataFrame:
    """Definitions, imports and references with the scope they belong to.

    Functions and classes are hoisted: their name belongs to the scope around the one they open.
    """
    r = caps.where("kind IN ('def', 'import', 'ref')").select(*FILE, "ord", "kind", "sub", "name", F.col("start_row").alias("s"), F.col("start_row").alias("e"), "start_col")
    x = smallest_enclosing(r, scopes)
    par = scopes.select(*FILE, "scope_id", F.col("parent_id").alias("up"), F.col("start_row").alias("sr"), F.col("name").alias("sname"))
    x = x.join(par, [*FILE, "scope_id"], "left")
    own = (F.col("kind") == "def") & F.col("sub").isin("function", "class") & (F.col("sr") == F.col("s")) & (F.col("sname") == F.col("name"))
    return x.withColumn("scope_id", F.when(own, F.col("up")).otherwise(F.col("scope_id"))).drop("up", "sr", "sname", "e").withColumnRenamed("s", "row")


def resolved_refs(rows: DataFrame) -> DataFrame:
    """Each reference with the definition and the import of its name in the file; those with neither are dropped.

    Of several definitions the last on the first line counts, of several imports the first.
    """
    defs = rows.where("kind = 'def'").groupBy(*FILE, "name").agg(F.min_by("ord", F.struct("row", (-F.col("ord")).alias("o"))).alias("def_ord"))
    imps = rows.where("kind = 'import'").groupBy(*FILE, "name").agg(F.min("ord").alias("import_ord"))
    refs = rows.where("kind = 'ref'").select(*FILE, "ord", "name", "row", "scope_id")
    return refs.join(defs, [*FILE, "name"], "left").join(imps, [*FILE, "name"], "left").where("def_ord IS NOT NULL OR import_ord IS NOT NULL")


def call_refs(caps: DataFrame) -> DataFrame:
    """Each call with the first reference of its name on its lines, null if none."""
    c = caps.where("kind = 'call'").select(*FILE, F.col("ord").alias("call"), "name", F.col("start_row").alias("s"), F.col("end_row").alias("e"))
    r = caps.where("kind = 'ref'").select(*FILE, F.col("ord").alias("ref"), F.col("name").alias("n"), F.col("start_row").alias("row"))
    right = r.select(F.col("repo_id").alias("r_repo"), F.col("file_path").alias("r_file"), "ref", "n", "row")
    on = F.col("repo_id").eqNullSafe(F.col("r_repo")) & (F.col("file_path") == F.col("r_file")) & (F.col("name") == F.col("n")) & F.col("row").between(F.col("s"), F.col("e"))
    return c.join(right, on, "left").groupBy(*FILE, "call", "name").agg(F.min("ref").alias("ref"))


def module_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Each import with the first file of its repository whose path ends in the module's parts.

    imports(repo_id, module, ..), files(repo_id, file_path): every suffix of a path, without its ending and without
    '__init__', is a key, so the suffix match is an equi-join.
    """
    stem = F.regexp_replace(F.regexp_replace("file_path", r"\.py$", ""), r"/__init__$", "")
    parts = F.split(stem, "/")
    keys = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "."))
    k = files.where("file_path LIKE '%.py'").select("repo_id", F.explode(keys).alias("module"), F.col("file_path").alias("target")).groupBy("repo_id", "module").agg(F.min("target").alias("target"))
    return imports.join(k, ["repo_id", "module"], "left")


def classified_imports(imports: DataFrame, system: list[str], third_party: list[str]) -> DataFrame:
    """system, third_party, local or unknown, the first that holds (N8). imports(root, target): target is a local file or null."""
    kind = F.when(F.col("root").isin(system), "system").when(F.col("root").isin(third_party), "third_party").when(F.col("target").isNotNull(), "local").otherwise("unknown")
    return imports.withColumn("import_kind", kind)


def exports(rows: DataFrame) -> DataFrame:
    """Functions and classes that a file defines at its top."""
    return rows.where("kind = 'def' AND sub IN ('function', 'class') AND scope_id = 0").select(*FILE, "ord", "name", "sub").distinct()


def import_exports(imports: DataFrame, exported: DataFrame) -> DataFrame:
    """Imports with the definition that they name (N11): repo_id, file_path, name, target, def_ord.

    imports(repo_id, file_path, name, target), exported(repo_id, file_path, name, ord). Where the target is a package's
    '__init__.py', a name that it does not define itself is looked up once more in the files it imports it from.
    """
    i = imports.where("target IS NOT NULL").select("repo_id", "file_path", "name", "target").distinct()
    e = exported.select("repo_id", F.col("file_path").alias("target"), "name", F.col("ord").alias("def_ord"))
    direct = i.join(e, ["repo_id", "target", "name"])
    passed = i.where(F.col("target").endswith("__init__.py")).join(direct.select("repo_id", "target", "name").distinct(), ["repo_id", "target", "name"], "left_anti")
    inner = i.where(F.col("file_path").endswith("__init__.py")).select("repo_id", F.col("file_path").alias("via"), "name", F.col("target").alias("inner"))
    once = passed.withColumnRenamed("target", "via").join(inner, ["repo_id", "via", "name"]).select("repo_id", "file_path", "name", F.col("inner").alias("target")).join(e, ["repo_id", "target", "name"])
    return direct.select("repo_id", "file_path", "name", "target", "def_ord").unionByName(once.select("repo_id", "file_path", "name", "target", "def_ord")).where("file_path <> target").distinct()


def repo_edges(rows: DataFrame, imports: DataFrame, exported: DataFrame) -> DataFrame:
    """Edges from scopes that use an imported name to the definition it names in a local file.

    imports(repo_id, file_path, name, target). One edge per pair of scope and definition, with the last reference.
    """
    refs = rows.where("kind = 'ref'").select("repo_id", "file_path", "name", "scope_id", "ord")
    x = refs.join(import_exports(imports, exported), ["repo_id", "file_path", "name"])
    return x.groupBy("repo_id", "file_path", "scope_id", "target", "def_ord").agg(F.max_by("name", "ord").alias("name"), F.count("*").alias("n_refs"))


def chunk_edges(edges: DataFrame, chunks: DataFrame, scopes: DataFrame, caps: DataFrame) -> DataFrame:
    """Repository edges lifted to chunks by the lines of the scope and of the definition.

    chunks(repo_id, file_path, ord, start_line, end_line): the first chunk that overlaps the lines counts.
    """
    sc = scopes.select("repo_id", "file_path", "scope_id", F.col("start_row").alias("src_row"))
    d = caps.select("repo_id", F.col("file_path").alias("target"), F.col("ord").alias("def_ord"), F.col("start_row").alias("dst_row"))
    x = edges.join(sc, ["repo_id", "file_path", "scope_id"], "left").join(d, ["repo_id", "target", "def_ord"]).withColumn("src_row", F.coalesce("src_row", F.lit(1)))
    c = chunks.select("repo_id", "file_path", "ord", "start_line", "end_line")
    src = c.select("repo_id", "file_path", F.col("ord").alias("src_ord"), F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    dst = c.select("repo_id", F.col("file_path").alias("target"), F.col("ord").alias("dst_ord"), F.col("start_line").alias("c"), F.col("end_line").alias("d"))
    y = x.join(src, ["repo_id", "file_path"]).where(F.col("src_row").between(F.col("a"), F.col("b"))).join(dst, ["repo_id", "target"]).where(F.col("dst_row").between(F.col("c"), F.col("d")))
    return y.groupBy("repo_id", "file_path", "scope_id", "target", "def_ord", "name").agg(F.min("src_ord").alias("src_ord"), F.min("dst_ord").alias("dst_ord"))


def name_edges(refs: DataFrame, defs: DataFrame, group: list[str]) -> DataFrame:
    """Edges between chunks of a group of which one refers to a name that the other defines, one per pair, by its first name.

    refs(group.., chunk, name, ord), defs(group.., chunk, name): distinct before they meet, and names meet within their
    repository only, so that a common name does not pair chunks that cannot know each other.
    """
    r = refs.groupBy(*group, F.col("chunk").alias("src"), "name").agg(F.min("ord").alias("o"))
    d = defs.select(*group, F.col("chunk").alias("dst"), "name").distinct()
    return r.join(d, [*group, "name"]).where("src <> dst").groupBy(*group, "src", "dst").agg(F.min_by("name", F.struct("o", "name")).alias("name"))


def lifted(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges between the clusters of two chunks, multi-edges counted (N16). edges(src, dst), members(chunk, cluster)."""
    m = members.groupBy("chunk").agg(F.min("cluster").alias("cluster"))
    a = m.select(F.col("chunk").alias("src"), F.col("cluster").alias("src_cluster"))
    b = m.select(F.col("chunk").alias("dst"), F.col("cluster").alias("dst_cluster"))
    return edges.join(a, "src").join(b, "dst").where("src_cluster <> dst_cluster").groupBy("src_cluster", "dst_cluster").agg(F.count("*").alias("n_edges"))


def merged_imports(members: DataFrame, cluster: str, imports: str = "imports") -> DataFrame:
    """Per cluster and imported chunk the names imported from it, sorted."""
    x = members.where(F.col(imports).isNotNull()).select(cluster, F.explode(imports).alias("source", "names")).select(cluster, "source", F.explode("names").alias("name"))
    return x.groupBy(cluster, "source").agg(F.sort_array(F.collect_set("name")).alias("names"))


def ref_counts(members: DataFrame, cluster: str, imports: str = "imports") -> DataFrame:
    """How often each name is imported in a cluster."""
    x = members.where(F.col(imports).isNotNull()).select(cluster, F.explode(imports).alias("source", "names")).select(cluster, F.explode("names").alias("name"))
    return x.groupBy(cluster, "name").agg(F.count("*").alias("n"))
