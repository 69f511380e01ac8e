"""Structure from source text: blocks, captures, contexts, invocations, hunks and logs (B family).

Python files are read with the standard parser, file by file, in Arrow batches; a file that does not
parse gives one ERROR block and no captures.
"""

from __future__ import annotations

import ast
import re
import sys
import threading
import warnings
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def whole(each: Callable[..., Iterator[tuple]], *row) -> list[tuple]:
    """All that ``each`` yields for a row; a file nested too deeply for the usual stack is read on a larger one, never in part."""
    try:
        return list(each(*row))
    except RecursionError:
        pass
    out: list = []
    frames, stack = sys.getrecursionlimit(), threading.stack_size(512 << 20)
    sys.setrecursionlimit(max(frames, 400_000))
    try:
        t = threading.Thread(target=lambda: out.extend(each(*row)))
        t.start()
        t.join()
    finally:
        threading.stack_size(stack)
        sys.setrecursionlimit(frames)
    return out


def map_files(files: DataFrame, each: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that ``each(repo_id, file_path, content)`` yields, a slice of files at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out: list[tuple] = []
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    out.extend(whole(each, *row))
                if out:
                    yield pa.RecordBatch.from_pydict(dict(zip(arrow.names, map(list, zip(*out)))), schema=arrow)

    return files.select("repo_id", "file_path", "content").mapInArrow(run, schema)


def parse(text: str | None) -> ast.Module | None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return ast.parse(text or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None


# ----------------------------------------------------------------------------- blocks
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)


def _block_type(node: ast.AST, inside_class: bool) -> tuple[str, str] | None:
    if isinstance(node, _FUNCTION):
        return ("constructor" if inside_class and node.name == "__init__" else "function"), node.name
    if isinstance(node, ast.ClassDef):
        return "class", node.name
    if isinstance(node, (ast.Import, ast.ImportFrom)):
        return "import", (getattr(node, "module", None) or node.names[0].name)
    if isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
        target = node.targets[0] if isinstance(node, ast.Assign) else node.target
        return "assignment", ast.unparse(target)
    if isinstance(node, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.Match)):
        return "compound", type(node).__name__.lower()
    if isinstance(node, ast.stmt):
        return "statement", type(node).__name__.lower()
    return None


def _names(node: ast.AST | None) -> list[str]:
    return sorted({n.id for n in ast.walk(node) if isinstance(n, ast.Name)}) if node is not None else []


def _calls(node: ast.stmt) -> list[tuple[str, str]]:
    """Calls of a statement, by breadth; those of the statements within it are theirs."""
    out, todo = [], [node]
    for n in todo:
        if isinstance(n, ast.Call):
            out.append(("calls", ast.unparse(n.func)))
        todo += [c for c in ast.iter_child_nodes(n) if not isinstance(c, ast.stmt)]
    return out


def _blocks(repo_id, path, text) -> Iterator[tuple]:
    tree = parse(text)
    if tree is None:
        n = (text or "").count("\n") + 1
        yield repo_id, path, 0, None, "ERROR", "module", "", 1, n, [], [], 1
        return
    counter = [0]
    yield repo_id, path, 0, None, "module", "module", "", 1, (text or "").count("\n") + 1, [], [], 0

    def visit(node, parent: int, prefix: str, in_class: bool) -> Iterator[tuple]:
        taken: dict[tuple[str, str], int] = {}
        of_type: dict[str, int] = {}
        for child in ast.iter_child_nodes(node):
            kind = _block_type(child, in_class)
            if kind is None:
                if isinstance(child, (ast.ExceptHandler, ast.match_case)):
                    yield from visit(child, parent, prefix, False)
                continue
            type_, name = kind
            identifier = name if (type_, name) not in taken else f"{name}_{of_type.get(type_, 0)}"
            duplicate = int((type_, name) in taken and type_ in ("function", "class", "constructor"))
            taken[type_, name] = 1
            of_type[type_] = of_type.get(type_, 0) + 1
            counter[0] += 1
            own = counter[0]
            full = f"{prefix}.{identifier}" if prefix else identifier
            start = min([child.lineno, *(d.lineno for d in getattr(child, "decorator_list", []))])
            params, refs = [], []
            if isinstance(child, _FUNCTION):
                a = child.args
                params = [x.arg for x in (*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else []))]
                refs = sorted({("type", n) for x in (*a.posonlyargs, *a.args, *a.kwonlyargs) if x.annotation for n in _names(x.annotation)} | {("type", n) for n in _names(child.returns)})
            elif isinstance(child, ast.ClassDef):
                refs = [("is_a", ast.unparse(b)) for b in child.bases]
            elif isinstance(child, ast.ImportFrom):
                refs = [("import", f"{'.' * child.level}{child.module or ''}.{x.name}") for x in child.names]
            elif isinstance(child, ast.Import):
                refs = [("import", x.name) for x in child.names]
            refs += _calls(child)
            yield repo_id, path, own, parent, type_, identifier, full, start, child.end_lineno, params, [{"kind": k, "target": v} for k, v in refs], duplicate
            yield from visit(child, own, full, isinstance(child, ast.ClassDef))

    yield from visit(tree, 0, "", False)


def blocks(files: DataFrame) -> DataFrame:
    """One row per block of each .py file, in pre-order: its place in the tree, type, unique identifier, dotted path,
    lines, parameters, relationships, and whether its name repeats a sibling's."""
    return map_files(
        files.where(F.col("file_path").endswith(".py")), _blocks,
        "repo_id INT, file_path STRING, block INT, parent INT, type STRING, identifier STRING, path STRING, start_line INT, end_line INT, params ARRAY<STRING>, relationships ARRAY<STRUCT<kind: STRING, target: STRING>>, duplicate INT",
    )


# ------------------------------------------------------------------------- Java blocks
_J_NO_CODE = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"\"\".*?(?:\"\"\"|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?", re.S)
_J_TYPE = re.compile(r"\b(class|interface|enum|record)\s+(\w+)")
_J_METHOD = re.compile(r"(\w+)\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?:throws\s[\w.,\s]+)?$")
_J_NO_METHOD = frozenset("if for while switch catch synchronized try return new else do".split())


def _java_blocks(repo_id, path, text) -> Iterator[tuple]:
    text = text or ""
    code = _J_NO_CODE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    line_at = lambda at: code.count("\n", 0, at) + 1
    found: list[list] = [[0, None, "module", "module", "", 1, code.count("\n") + 1, [], []]]
    stack: list[int | None] = [0]
    begin = 0

    def holder() -> int:
        return next(b for b in reversed(stack) if b is not None)

    for m in re.finditer(r"[{};]", code):
        head = code[begin : m.start()]
        start = begin + len(head) - len(head.lstrip())
        if m[0] == "{":
            up = found[holder()]
            own = None
            declared = re.sub(r"@\w+(?:\.\w+)*(?:\s*\([^()]*\))?", " ", head).strip()
            if t := _J_TYPE.search(declared.partition("(")[0] if " record " not in f" {declared}" else declared):
                refs = [{"kind": "is_a", "target": n.strip()} for n in re.findall(r"(?:extends|implements)\s+([\w.<>,\s]+?)(?=\bextends\b|\bimplements\b|\bpermits\b|$)", declared) for n in re.split(r",(?![^<]*>)", n)]
                own = ["class" if t[1] == "record" else t[1], t[2], [], refs]
            elif up[2] in ("class", "interface", "enum") and "=" not in declared and (t := _J_METHOD.search(declared)) and t[1] not in _J_NO_METHOD:
                params = [p.split()[-1].strip(".[]") for p in re.split(r",(?![^<]*>)", t[2]) if p.strip()]
                own = ["constructor" if t[1] == up[3] else "function", t[1], params, []]
            if own:
                full = f"{up[4]}.{own[1]}" if up[4] else own[1]
                found.append([len(found), up[0], own[0], own[1], full, line_at(start), 0, own[2], own[3]])
                stack.append(len(found) - 1)
            else:
                stack.append(None)
        elif m[0] == "}":
            if len(stack) > 1 and (b := stack.pop()) is not None:
                found[b][6] = line_at(m.start())
        elif t := re.match(r"\s*import\s+(?:static\s+)?([\w.*]+)\s*$", head):
            found.append([len(found), holder(), "import", t[1], t[1], line_at(start), line_at(m.start()), [], [{"kind": "import", "target": t[1]}]])
        begin = m.end()
    seen: set = set()
    for b, up, kind, name, full, first, last, params, refs in found:
        twice = int((up, kind, name) in seen and kind in ("class", "interface", "enum"))
        seen.add((up, kind, name))
        yield repo_id, path, b, up, kind, name, full, first, last or found[0][6], params, refs, twice


def java_blocks(files: DataFrame) -> DataFrame:
    """As blocks(), for .java files (B4): types, constructors, methods and imports by their declarations and brackets.

    Overloaded methods are no repeated names; what a file that breaks off leaves open ends with the file.
    """
    return map_files(
        files.where(F.col("file_path").endswith(".java")), _java_blocks,
        "repo_id INT, file_path STRING, block INT, parent INT, type STRING, identifier STRING, path STRING, start_line INT, end_line INT, params ARRAY<STRING>, relationships ARRAY<STRUCT<kind: STRING, target: STRING>>, duplicate INT",
    )


# --------------------------------------------------------------------------- captures
def _captures(repo_id, path, text) -> Iterator[tuple]:
    tree = parse(text)
    if tree is None:
        return
    out: list[tuple] = []

    def add(kind, sub, name, node, end=None):
        out.append((node.lineno, node.col_offset, kind, sub, name, end or node.end_lineno))

    class Visit(ast.NodeVisitor):
        def function(self, node):
            add("def", "function", node.name, node, node.lineno)
            for d in node.decorator_list:
                self.visit(d)
            add("scope", "function", node.name, node)
            for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, *([node.args.vararg] if node.args.vararg else []), *([node.args.kwarg] if node.args.kwarg else [])):
                add("def", "parameter", a.arg, a)
                if a.annotation:
                    self.visit(a.annotation)
            for d in (*node.args.defaults, *(x for x in node.args.kw_defaults if x)):
                self.visit(d)
            if node.returns:
                self.visit(node.returns)
            for s in node.body:
                self.visit(s)

        visit_FunctionDef = visit_AsyncFunctionDef = function

        def visit_ClassDef(self, node):
            add("def", "class", node.name, node, node.lineno)
            for d in (*node.decorator_list, *node.bases, *(k.value for k in node.keywords)):
                self.visit(d)
            add("scope", "class", node.name, node)
            for s in node.body:
                self.visit(s)

        def comprehension(self, node):
            add("scope", "comprehension", type(node).__name__.lower(), node)
            self.generic_visit(node)

        visit_ListComp = visit_SetComp = visit_DictComp = visit_GeneratorExp = comprehension

        def visit_Lambda(self, node):
            add("scope", "lambda", "lambda", node)
            for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs):
                add("def", "parameter", a.arg, a)
            self.visit(node.body)

        def visit_Import(self, node):
            for a in node.names:
                add("import", a.name, a.asname or a.name.split(".")[0], node, node.lineno)

        def visit_ImportFrom(self, node):
            for a in node.names:
                add("import", f"{'.' * node.level}{node.module or ''}", a.asname or a.name, node, node.lineno)

        def visit_Name(self, node):
            if isinstance(node.ctx, ast.Store):
                add("def", "variable", node.id, node)
            else:
                add("ref", "name", node.id, node)

        def visit_Call(self, node):
            f = node.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
            if name:
                add("call", "call", name, node)
            self.generic_visit(node)

    Visit().visit(tree)
    for n, (row, col, kind, sub, name, end) in enumerate(sorted(out, key=lambda x: (x[0], x[1], -x[5])), 1):
        yield repo_id, path, n, kind, sub, name, row, end, col


def captures(files: DataFrame) -> DataFrame:
    """Scopes, definitions, imports, references and calls of each .py file, numbered in order of the text."""
    return map_files(files.where(F.col("file_path").endswith(".py")), _captures, "repo_id INT, file_path STRING, ord INT, kind STRING, sub STRING, name STRING, start_row INT, end_row INT, start_col INT")


def contexts(caps: DataFrame) -> DataFrame:
    """Per file its classes and functions with their parameters, nested."""
    f = caps.where("kind = 'def' AND sub IN ('class', 'function', 'parameter')")
    return f.groupBy("repo_id", "file_path").agg(F.sort_array(F.collect_list(F.struct("ord", "sub", "name"))).alias("context"))


def _invokes(repo_id, path, text) -> Iterator[tuple]:
    tree = parse(text)
    if tree is None:
        return

    def visit(node, function, seen):
        if isinstance(node, _FUNCTION):
            function = node.name
            seen = seen | {a.arg for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs) if a.annotation is not None and "Client" in ast.unparse(a.annotation)}
        if isinstance(node, ast.Assign) and isinstance(node.value, ast.Call) and "Client" in ast.unparse(node.value.func):
            seen |= {t.id for t in node.targets if isinstance(t, ast.Name)}
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Name) and node.func.value.id in seen:
            yield repo_id, path, node.func.value.id, node.func.attr, function, node.lineno
        for child in ast.iter_child_nodes(node):
            yield from visit(child, function, seen)

    yield from visit(tree, "", set())


def invocations(files: DataFrame) -> DataFrame:
    """Method calls on variables that hold a client, with the enclosing function and line."""
    return map_files(files.where(F.col("file_path").endswith(".py")), _invokes, "repo_id INT, file_path STRING, variable STRING, method STRING, function STRING, line_no INT")


# ------------------------------------------------------------------------ lines: diffs, logs, greps
def numbered_lines(files: DataFrame, text: str = "content") -> DataFrame:
    """One row per line, numbered from 1, without its carriage return."""
    rest = [c for c in files.columns if c != text]
    return files.where(F.col(text).isNotNull()).select(*rest, F.posexplode(F.split(text, "\n")).alias("__p", "line")).select(*rest, (F.col("__p") + 1).alias("line_no"), F.regexp_replace("line", r"\r$", "").alias("line"))


def hunks(patches: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    """(keys, file, start, end) of the hunks of unified diffs.

    A hunk's lines are trimmed by its context: start = old start + max(1, min(3, old start - 3)), end = start + max(0, old length - 7).
    Headers without lengths are skipped.  'diff --git a/' and '--- a/' name the file of what follows, so the hunks of a
    new file, which has '/dev/null' in the second place, are its own.
    """
    lines = numbered_lines(patches.select(*keys, text), text)
    git, minus = r"^diff --git a/(.+) b/.+", r"^--- a/(.+)"
    so_far = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of = lambda header: F.nullif(F.regexp_extract("line", header, 1), F.lit(""))
    named = lines.withColumn("file", F.last(F.coalesce(of(git), of(minus)), True).over(so_far)).where("file IS NOT NULL")
    m = F.regexp_extract
    header = r"^@@ -(\d+),(\d+) \+(\d+),(\d+) @@"
    h = named.where(F.col("line").rlike(header)).withColumn("a", m("line", header, 1).cast("int")).withColumn("n", m("line", header, 2).cast("int"))
    start = F.col("a") + F.greatest(F.lit(1), F.least(F.lit(3), F.col("a") - 3))
    return h.select(*keys, "file", "line_no", start.alias("start"), (start + F.greatest(F.lit(0), F.col("n") - 7)).alias("end"))


def log_errors(text: Column) -> Column:
    """(file, line, message) structs of compiler messages 'path:line: error: message' (B20)."""
    pattern = r"(?m)^(\S+?):(\d+):(?:\d+:)? error: (.*)$"
    parts = [F.regexp_extract_all(text, F.lit(pattern), i) for i in (1, 2, 3)]
    return F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("file", "line", "message"))])


def grep(files: DataFrame, needle: str) -> DataFrame:
    """Lines that hold a text, whatever its case (B22). Files without it are passed over before they are cut into lines."""
    low = needle.lower()
    return numbered_lines(files.where(F.contains(F.lower("content"), F.lit(low)))).where(F.contains(F.lower("line"), F.lit(low)))


def tree_lines(paths: DataFrame, group: str, path: str = "file_path") -> DataFrame:
    """The folders and files of a group as an indented tree: folders first, then by name."""
    parts = F.split(path, "/")
    nodes = paths.select(group, parts.alias("parts")).select(
        group, F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.struct(F.slice("parts", 1, n).alias("p"), (n == F.size("parts")).alias("leaf")))).alias("x")
    )
    nodes = nodes.select(group, "x.p", "x.leaf").distinct()
    # a sort key in which folders come before files at every level
    key = F.array_join(F.transform("p", lambda s, i: F.concat(F.when((i == F.size("p") - 1) & F.col("leaf"), "1").otherwise("0"), s)), "/")
    return nodes.select(group, key.alias("sort_key"), F.concat(F.repeat(F.lit("  "), F.size("p") - 1), F.element_at("p", -1), F.when(F.col("leaf"), "").otherwise("/")).alias("line"))
