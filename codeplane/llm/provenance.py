"""Files that nobody wrote by hand for their repository: tool output, minified code, vendored copies, data.

Evidence is gathered per file: notices in its header, met by one pass of a multi-pattern automaton;
rules on its path; and the texture of its lines.  A path alone decides only where it names a place
that is nothing else (``node_modules``), and words alone only in a comment that says so of this file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from .files import files, map_rows

# ------------------------------------------------------------- fixed values: notices and paths
#: Notice -> what it tells: 'tool' the file is the output of a tool; 'keep' that it must not be edited,
#: which counts with a 'made'; 'made' that something made it; 'copy' a vendored copy; 'lock' a lock file; 'not' the opposite.
NOTICES = {
    "@generated": "tool", "<auto-generated": "tool", "autogenerated file": "tool", "auto-generated file": "tool", "automatically generated file": "tool", "@generated(": "tool",
    "generated by": "made", "generated from": "made", "generated with": "made", "generated using": "made", "auto-generated": "made", "autogenerated": "made", "automatically generated": "made",
    "machine generated": "made", "machine-generated": "made", "code generated": "made", "generated code": "made", "generated file": "made", "generated automatically": "made", "was generated": "made",
    "is generated": "made", "produced by": "made", "emitted by": "made", "built from": "made", "created by": "made", "compiled from": "made", "compiled by": "made", "output of": "made", "transpiled": "made", "written by": "made",
    "automatisch erzeugt": "made", "automatisch generiert": "made", "generiert von": "made", "erzeugt durch": "made", "erzeugt von": "made", "automatiquement": "made", "généré par": "made", "generado por": "made",
    "generado automáticamente": "made", "generato da": "made", "gerado por": "made",
    "do not edit": "keep", "do not modify": "keep", "do not change": "keep", "don't edit": "keep", "don't modify": "keep", "not be edited": "keep", "not be modified": "keep", "changes will be lost": "keep",
    "changes will be overwritten": "keep", "will be overwritten": "keep", "edits will be lost": "keep", "instead of this file": "keep", "to refresh": "keep", "to regenerate": "keep", "to update this file": "keep",
    "nicht von hand": "keep", "nicht bearbeiten": "keep", "nicht ändern": "keep", "ne pas modifier": "keep", "ne pas éditer": "keep", "no editar": "keep", "no modificar": "keep", "non modificare": "keep", "não edite": "keep",
    "upstream:": "copy", "copied from": "copy", "vendored": "copy", "imported unchanged": "copy", "keep in sync with upstream": "copy", "send fixes upstream": "copy", "see upstream": "copy", "third-party copy": "copy",
    "third party copy": "copy", "taken verbatim": "copy", "bundled copy": "copy", "mirrored from": "copy", "imported from upstream": "copy", "forked from": "copy", "this is a copy of": "copy", "local copy of": "copy",
    "managed by the dependency resolver": "lock", "this file is generated by poetry": "lock", "yarn lockfile": "lock", "this lock file": "lock", "pinned dependencies, resolved": "lock",
    "not generated": "not", "not auto-generated": "not", "not autogenerated": "not", "no longer generated": "not", "not vendored": "not", "not copied": "not", "never generated": "not", "used to be generated": "not",
    "maintained by hand": "not", "edit this by hand": "not", "edited by hand": "not", "written by hand": "not", "hand-written": "not", "handwritten": "not", "hand-maintained": "not", "nicht generiert": "not", "nicht erzeugt": "not",
    "at run time": "not", "at runtime": "not", "no longer vendored": "not", "originally generated": "not", "safe to edit": "not",
}
VENDORED = re.compile(r"(?:^|/)(?:node_modules|bower_components|jspm_packages|site-packages|dist-packages|third[_-]?party|vendor|vendors|_vendor|_vendored|vendored|extern|externals|deps|contrib/upstream|Pods|Carthage|Godeps)/")
LOCK_NAME = re.compile(
    r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|bun\.lockb?|poetry\.lock|pdm\.lock|uv\.lock|Pipfile\.lock|composer\.lock|Gemfile\.lock|Cargo\.lock|go\.sum|mix\.lock|pubspec\.lock|"
    r"Podfile\.lock|Package\.resolved|gradle\.lockfile|packages\.lock\.json|flake\.lock|deno\.lock|[\w.-]+[.-]lock(?:file)?\.(?:toml|json|ya?ml))$"
)
MINIFIED_NAME = re.compile(r"[.-](?:min|bundle|packed|prod|chunk|umd|iife)\.(?:js|mjs|cjs|css|py)$|[.-][0-9a-f]{8,20}\.(?:js|css)$")

COMMENT = re.compile(r"^\s*(?:\#|//|/?\*+|<!--|--|;|%|\"\"\"|'''|\(\*|rem\b)", re.I)


@lru_cache(maxsize=1)
def _automaton():
    """A function from lower-case text to the kinds of the notices in it."""
    try:
        import ahocorasick
    except ImportError:
        return lambda text: {kind for notice, kind in NOTICES.items() if notice in text}
    automaton = ahocorasick.Automaton()
    for notice, kind in NOTICES.items():
        automaton.add_word(notice, kind)
    automaton.make_automaton()
    return lambda text: {kind for _, kind in automaton.iter(text)}


def header(text: str) -> list[str]:
    """The comments and docstrings before the first statement, one paragraph of comment lines each; annotations count.

    The header ends where the code begins, however long it is.
    """
    out: list[list[str]] = [[]]
    at, n = 0, len(text)
    quote = ""
    block = False
    while at < n:
        end = text.find("\n", at)
        end = n if end < 0 else end
        line = text[at:end].strip()
        at = end + 1
        if quote:
            out[-1].append(line)
            if quote in line:
                quote = ""
            continue
        if block:
            out[-1].append(line)
            if "*/" in line:
                block = False
            continue
        if not line:
            out.append([])
        elif line[:3] in ('"""', "'''"):
            out.append([line])
            if line.count(line[:3]) < 2:
                quote = line[:3]
        elif line.startswith("/*"):
            out.append([line])
            block = "*/" not in line
            if not block and line.partition("*/")[2].strip():
                break
        elif line[0] == "#" or line.startswith(("//", "--", ";", "<!--", "%")):
            out[-1].append(line)
        elif line.startswith(("package ", "import ", "from __future__", "'use strict'", '"use strict"', "@")):
            out.append([line] if line[0] == "@" else [])
        else:
            break
    return [" ".join(p) for p in out if p]


def notices(text: str) -> set[str]:
    """What the header says of the file: 'tool', 'copy' or 'lock'."""
    said: set[str] = set()
    find = _automaton()
    for paragraph in header(text):
        if len(paragraph) > 3 and paragraph[0] == "@":
            if re.match(r"@(?:javax\.annotation\.(?:processing\.)?)?Generated\b", paragraph):
                said.add("tool")
            continue
        kinds = find(paragraph.lower())
        if not kinds or "not" in kinds:
            continue
        if "tool" in kinds or {"made", "keep"} <= kinds:
            said.add("tool")
        said |= kinds & {"copy", "lock"}
    return said


#: What code generators and bundlers leave in their output, whatever its header says; True where it begins a line.
MARKS = {
    "_lr_method": True, "_lr_signature": True, "_lr_action_items": True, "DESCRIPTOR = _descriptor": True, "DESCRIPTOR=_descriptor": True, "_descriptor.FileDescriptor": False, "# snapshottest:": True, "// Jest Snapshot v": True,
    **{f"var __{name}{gap}{of}": False for name in ("assign", "extends", "awaiter", "decorate", "importDefault", "createBinding", "rest", "spreadArray") for gap in (" = ", "=") for of in ("(this", "this")},
    "__webpack_require__": False, "webpackBootstrap": False, "_interopRequireDefault": False, "_interopRequireWildcard": False, "//# sourceMappingURL=": True, 'Object.defineProperty(exports, "__esModule"': False, "Object.defineProperty(exports, '__esModule'": False,
    "# source: ": True, "# Generated by the gRPC": True, "/* A Bison parser": True, "/* parser generated by": True, "%%{init": True, "%{init": True, "// Code generated ": True,
}
#: What must follow a mark on its line.
FOLLOWS = {"# source: ": re.compile(r"[\w./-]+\.(?:proto|wire|thrift|fbs|avsc|idl|capnp)[ \t\r]*$", re.M), "// Code generated ": re.compile(r".* DO NOT EDIT"), "_lr_method": re.compile(r"\b"), "_lr_signature": re.compile(r"\b"), "_lr_action_items": re.compile(r"\b")}


@lru_cache(maxsize=1)
def _marks():
    """A function from a text to the ends of the marks in it, with the marks."""
    try:
        import ahocorasick
    except ImportError:
        return lambda text: ((m.end() - 1, mark) for mark in MARKS for m in re.finditer(re.escape(mark), text))
    automaton = ahocorasick.Automaton()
    for mark in MARKS:
        automaton.add_word(mark, mark)
    automaton.make_automaton()
    return automaton.iter


def marked(text: str) -> bool:
    """Whether a generator or bundler left its mark anywhere in the text; one pass of the automaton over the whole text."""
    for end, mark in _marks()(text):
        start = end + 1 - len(mark)
        if (not MARKS[mark] or start == 0 or text[start - 1] == "\n") and (mark not in FOLLOWS or FOLLOWS[mark].match(text, end + 1)):
            return True
    return False


LOCK_CONTENT = re.compile(r"\"lockfileVersion\"|\"integrity\"\s*:|\[\[package\]\]|^\s*(?:hash|checksum|integrity|resolved)\s*[:=]|^h1:|\"(?:content-hash|resolved|dist)\"\s*:|--hash=sha256:", re.M)
CODE = {"py", "pyi", "js", "mjs", "cjs", "jsx", "ts", "tsx", "java", "go", "rb", "c", "h", "cc", "cpp", "cs", "php", "css", "rs", "kt", "scala", "swift", "lua", "r", "pl"}
_WORD = re.compile(r"[^\W\d]\w*")
_SHAPE = re.compile(r"[^\W\d]\w*|\d[\w.]*|\s+")
_DATA_LINE = re.compile(
    r"\s*(?:[-+]?\d[\d.eExXa-fA-F_]*[\s,;|]*)+[\])};]*,?$|\s*[bru]?[\"'][A-Za-z0-9+/=\\._-]{24,}[\"'][,;+)\]]*$|\s*[\[({][^a-zA-Z(=:]*[\])}],?$|-?\w[\w.]*(?:[,;\t|]-?[\w. ]*){2,}$|"
    r"\s*[\[({]?\s*(?:[\"'][^\"']{0,40}[\"']|[-+]?[\d.eE]+)(?:\s*,\s*(?:[\"'][^\"']{0,40}[\"']|[-+]?[\d.eE]+|None|null|True|False|true|false)){2,}\s*[\])}]?,?$|\s*(?:\\x[0-9a-fA-F]{2}){8,}\\?$"
)
#: Bounds of the texture of minified code, of data and of repetition.
DENSE_BLANKS, DENSE_MEAN, DATA_SHARE, DATA_SIZE, VARIETY, VARIETY_LINES = 0.08, 80, 0.6, 1200, 0.55, 20


def _mask(m: re.Match) -> str:
    c = m[0][0]
    return "9" if c.isdigit() else "" if c.isspace() else "w"


def texture(text: str) -> str:
    """'minified', 'data' or 'repetitive' by the lines of a code file, or ''.

    Minified code has hardly a blank; data is numbers, rows and encoded strings for the most part of
    its characters; repetitive code has far fewer shapes of lines (names, numbers and blanks masked)
    than the square root of their number; a table of some dozens of rows amid other code is not.
    """
    body = [l for l in text.split("\n") if l.strip() and not COMMENT.match(l)]
    n = len(body)
    if not n:
        return ""
    size = sum(map(len, body))
    if size / n >= DENSE_MEAN and sum(l.count(" ") for l in body) < DENSE_BLANKS * size and size >= 200:
        words = _WORD.findall(text)
        if len(words) * 14 >= size:
            return "minified"
    if size >= DATA_SIZE:
        data = sum(len(l) for l in body if len(l) > 300 and len(_WORD.findall(l)) * 14 < len(l) or len(l) <= 300 and _DATA_LINE.match(l.rstrip("\r")))
        if data >= DATA_SHARE * size:
            return "data"
    if n >= VARIETY_LINES:
        shapes: dict[str, int] = {}
        for l in body:
            s = _SHAPE.sub(_mask, l)
            shapes[s] = shapes.get(s, 0) + 1
        if len(shapes) < VARIETY * n**0.5:
            return "repetitive"
    return ""


def classify(path: str, text: str) -> tuple[str, str]:
    """(kind, evidence) of a file that was not written by hand: tool, lock, vendored, minified or data; ('', '') otherwise."""
    ending = path.rpartition("/")[2].rpartition(".")[2].lower()
    said = notices(text)
    if "copy" in said:
        return "vendored", "notice"
    if VENDORED.search(path):
        return "vendored", "path"
    if "tool" in said:
        return "tool", "notice"
    if (LOCK_NAME.search(path) or "lock" in said) and LOCK_CONTENT.search(text):
        return "lock", "name" if "lock" not in said else "notice"
    if ending not in CODE:
        return "", ""
    if marked(text):
        return "tool", "marks"
    kind = texture(text)
    if kind == "repetitive":
        return "tool", "texture"
    if not kind and MINIFIED_NAME.search(path) and text.strip() and text.count(" ") < 2 * DENSE_BLANKS * len(text):
        return "minified", "name"
    return (kind, "texture") if kind else ("", "")


def _each(repo_id, path: str, text: str) -> Iterator[tuple]:
    kind, evidence = classify(path, text or "")
    yield repo_id, path, kind or None, evidence or None, len(text or "")


def provenance(chunks: DataFrame) -> DataFrame:
    """One row per file: kind (tool, lock, vendored, minified, data; null: written by hand), evidence, characters.

    Null and empty texts are judged by their path alone.  The path is the clean one; rows without a path name no file.
    """
    return map_rows(files(chunks), _each, "repo_id INT, file_path STRING, kind STRING, evidence STRING, n_chars INT")


def not_by_hand(chunks: DataFrame) -> DataFrame:
    """(repo_id, file_path) of the files that are no hand-written source."""
    return provenance(chunks).where("kind IS NOT NULL").select("repo_id", "file_path")
