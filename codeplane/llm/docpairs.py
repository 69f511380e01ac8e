"""Functions paired with their documentation: grammars per language over lexed files.

``extract`` finds every named function and method of a file together with the documentation that
its author gave it; ``trivial`` says whether that documentation informs.  Both work on whole texts.
"""

from __future__ import annotations

import ast
import inspect
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .depth import deeply
from .lexing import JAVA_WORDS, JS_WORDS, PY_WORDS, Lexed
from .peg import Grammar, Packrat


def _begins_line(p: Packrat, pos: int) -> bool:
    return pos == 0 or p.s[pos - 1] in "\nN"


def _after_statement(p: Packrat, pos: int) -> bool:
    """Whether a member or statement may begin at pos."""
    i = pos - 1
    while i >= 0 and p.s[i] in "#\nN":
        i -= 1
    return i < 0 or p.s[i] in "{};,"


_PREDICATES = {"bol": _begins_line, "fresh": _after_statement}

# A word of kinds: 'n' and the contextual words may be names.
_PY_NAME = "[n" + "".join(PY_WORDS[w] for w in ("match", "case", "type")) + "]"
_JS_NAME = "[n" + "".join(JS_WORDS[w] for w in ("let", "static", "async", "of", "get", "set", "await", "yield")) + "]"
_JS_KEY = "[n" + "".join(k for w, k in JS_WORDS.items() if w not in ("if", "for", "while", "switch", "with", "catch", "function")) + "]"
_JAVA_NAME = "[n" + "".join(JAVA_WORDS[w] for w in ("record", "var", "yield", "sealed", "permits")) + "]"
_JAVA_PRIMITIVE = "".join(JAVA_WORDS[w] for w in ("boolean", "byte", "char", "double", "float", "int", "long", "short", "void"))
_JAVA_MODIFIER = "".join(JAVA_WORDS[w] for w in ("abstract", "default", "final", "native", "private", "protected", "public", "static", "strictfp", "synchronized"))

# 'N' is a line end with blank lines behind it: no comment stands directly above it.
_GROUPS = r"""
gap       <- ~[#\nN\\]*~
group     <- ~\(_*+\)~ / '(' inner* ')'
square    <- ~\[_*+\]~ / '[' inner* ']'
curly     <- ~\{_*+\}~ / '{' inner* '}'
inner     <- ~[^()\[\]{}]++~ / group / square / curly
lead      <- <bol> ~(?:#\n)+~
""".replace("_", r"(?:[^()\[\]{}]++|\([^()\[\]{}]*+\)|\[[^()\[\]{}]*+\]|\{[^()\[\]{}]*+\})")  # what is nested once is read at once

PYTHON = Grammar(
    _GROUPS
    + rf"""
unit      <- (doc:lead)? decorator* ~{{async}}?{{def}}\\*~ name:~{_PY_NAME}~ square? group ~A[^:()\[\]{{}}\nN]+(?=:)~? returns? ':' body
decorator <- '@' ~[^\nN()\[\]{{}}]*~ inner2* ~[\nN](?:#[\nN])*~
inner2    <- (group / square / curly) ~[^\nN()\[\]{{}}]*~
returns   <- 'A' (~[^:()\[\]{{}}\nN]+~ / group / square / curly)+
body      <- ~[#\nN\\]*~ (text:~s[s\nN#\\]*(?<=s)(?=[\nN#;]|\Z)~ / text:paren) / ''
paren     <- ~\([s\nN#]*\)(?=[\nN#;]|\Z)~
""",
    PY_WORDS,
    _PREDICATES,
)

JAVASCRIPT = Grammar(
    _GROUPS
    + rf"""
unit      <- doc:lead? (func / arrow / method)
func      <- ~(?:{{export}}{{default}}?)?{{async}}?{{function}}\*?~ name:~{_JS_NAME}~ gap '('
arrow     <- ~{{export}}?{{const}}\n?~ name:~{_JS_NAME}~ gap '=' gap ~{{async}}?~ (~{_JS_NAME}~ / group) 'A'
method    <- <fresh> ~(?:{{static}}(?=[^(]))?(?:{{async}}(?=[^(]))?\*?(?:[{{get}}{{set}}](?=[^(]))?~ name:~{_JS_KEY}(?=\()~ group ~#?~ '{{'
""",
    JS_WORDS,
    _PREDICATES,
)

JAVA = Grammar(
    _GROUPS
    + rf"""
unit      <- doc:lead? <fresh> prefix (method / constructor)
prefix    <- (annotation / ~[{_JAVA_MODIFIER}#\nN]+~)*
annotation <- ~@{_JAVA_NAME}(?:\.{_JAVA_NAME})*~ group?
method    <- generic? ~\n?~ type ~\n?~ name:~{_JAVA_NAME}~ gap group ~(?:\[\])*~ throws? gap (~[;{{]~ / '{{default}}')
constructor <- generic? name:~{_JAVA_NAME}(?=\()~ group throws? gap '{{'
throws    <- ~[#\nN]*{{throws}}[^;{{]*~
type      <- ~[{_JAVA_PRIMITIVE}](?:\[\])*~ / ~{_JAVA_NAME}(?:\.{_JAVA_NAME})*~ generic? ~(?:\.{_JAVA_NAME})*(?:\[\])*~
generic   <- '<' (~[^<>(){{}};]+~ / generic)* '>'
""",
    JAVA_WORDS,
    _PREDICATES,
)

GRAMMARS = {"py": PYTHON, "js": JAVASCRIPT, "java": JAVA}
# Where a unit may begin: at comments that lead to one, or at its first kind.
_LEAD = r"(?:(?<=[\nN])|\A)(?:#\n)+"
_PY_START = f"@|{PY_WORDS['async']}?{PY_WORDS['def']}"
_JS_START = f"{JS_WORDS['export']}|{JS_WORDS['async']}?{JS_WORDS['function']}|{JS_WORDS['const']}"
_JS_METHOD = f"(?:\\*|{_JS_KEY})*{_JS_KEY}\\("
_JAVA_START = f"@|<|[{_JAVA_MODIFIER}{_JAVA_PRIMITIVE}]|{_JAVA_NAME}(?=[n.<\\[(])"
_STARTS = {
    "py": re.compile(f"{_LEAD}(?={_PY_START})|{_PY_START}"),
    "js": re.compile(f"{_LEAD}(?={_JS_START}|{_JS_METHOD})|{_JS_START}|(?<=[{{}};,\\nN])(?={_JS_METHOD})"),
    "java": re.compile(f"{_LEAD}(?={_JAVA_START})|(?<=[{{}};\\nN#])(?:{_JAVA_START})|\\A(?:{_JAVA_START})"),
}
def _comment_text(comments: list[str]) -> list[str]:
    """Lines of the comment that stands directly above: the last block comment, or the last run of line comments."""
    out: list[str] = []
    for c in reversed(comments):
        c = c.strip()
        if c.startswith("/*"):
            if out:
                break
            body = c[2:-2] if c.endswith("*/") else c[2:]
            return [re.sub(r"^\s*\*+ ?", "", l).strip() for l in body.lstrip("*!").split("\n")]
        out.append(re.sub(r"^(?:#+[:!]?|//+!?)", "", c).strip())
    return out[::-1]


_PLAIN = re.compile(r"[ \t]*[rRuU]?(\"\"\"|'''|\"|')([^\\]*)\1", re.S)


def _string(tokens: list[str]) -> str | None:
    """What the string literals say together, as a docstring."""
    if len(tokens) == 1 and (m := _PLAIN.fullmatch(tokens[0])):
        value = m[2].replace("\r\n", "\n").replace("\r", "\n")
    else:
        try:
            value = ast.literal_eval("(" + "".join(tokens).strip() + "\n)")
        except (ValueError, SyntaxError, MemoryError):
            return None
    return inspect.cleandoc(value) if "\n" in value or "\t" in value else value.lstrip()


def extract(text: str, language: str, lexed: Lexed) -> Iterator[tuple[str, int, int, int, str, str]]:
    """(name, line of the name, start, end of the header, documentation, its source) of every function."""
    s, tokens = lexed.kinds, lexed.tokens
    p = Packrat(GRAMMARS[language], s)
    line, counted = 1, 0
    pos, n = 0, len(s)
    starts = _STARTS[language].search
    while m := starts(s, pos):
        at = m.start()
        end, found = p.apply("unit", at)
        if end < 0:
            # comments that lead to nothing are passed whole; what they lead to is tried by itself
            pos = max(m.end(), at + 1) if s[at] == "#" else at + 1
            continue
        caught = {c[0]: (c[1], c[2]) for c in found}
        name_at, name_end = caught["name"]
        start = lexed.start(name_at)
        line += text.count("\n", counted, start)
        counted = start
        documentation, source = "", "none"
        if "text" in caught:
            a, b = caught["text"]
            value = _string(tokens[a:b])
            if value is not None:
                documentation, source = value, "docstring"
        if source == "none" and "doc" in caught:
            a, b = caught["doc"]
            lines = _comment_text(tokens[a:b:2])
            documentation, source = "\n".join(lines).strip("\n"), "comment"
        yield tokens[name_at].strip(), line, lexed.start(at), lexed.end(min(end, n) - 1), documentation, source
        pos = name_end  # nested functions begin behind the header


# ------------------------------------------------------------------ informativeness
# Directives to tools, placeholders and words that say nothing beside the name.
DIRECTIVES = re.compile(
    r"^(?:type:\s*ignore|noqa\b|pylint\s*:|fmt\s*:|pragma\b|eslint|@ts-|ts-ignore|prettier-|nosonar|checkstyle|mypy\s*:|ruff\s*:|yapf\s*:|isort\s*:|istanbul|noinspection|"
    r"js[hl]int|c8 ignore|@formatter|flake8\s*:|nosec\b|tslint|pyright\s*:|coding\s*[:=]|-\*-|clang-|noformat|spell|cspell|sonar|deepcode|coverage\s*:|"
    r"(?:global|globals|exported)\s+\w+\s*$|#?region\b|#?endregion\b|language=|@suppress|suppresswarnings|@flow\b|@jsx\b|@__pure__|#__pure__|vim?:|vim:)",
    re.I,
)
PLACEHOLDER = re.compile(
    r"^\W*(?:to-?\s?dos?\b|fix-?me\b|xxx\b|tbd\b|tba\b|tbc\b|hack\b|wip\b|n/?a\b|none\b|undocumented\b|docstring\b|documentation\s+(?:goes|here|to|for|missing|pending)|missing\s+doc|no\s+doc|needs?\s+doc|"
    r"(?:add|insert|write|put|enter|provide|fill in)\s+(?:a\s+|an\s+|the\s+|your\s+|some\s+|in\s+)*(?:doc|desc|comment|summary|text|explanation|detail)|"
    r"(?:[<\[({]+\s*)?(?:description|summary|doc|docs|docstring|documentation|comment|short description|one-line summary)(?:\s*[>\])}]+)?\s*[.:]?\s*(?:goes here|here|missing|pending|to come|tbd|todo)?\W*$|"
    r"lorem ipsum|placeholder\b|auto-?generated\s+(?:method|constructor|function|catch)\s+(?:stub|block)|(?:method|function)\s+(?:stub|description)\b|description of\s*\W*$|"
    r"(?:not\s+(?:yet\s+)?|un)(?:documented|described|written)\b.{0,20}$|your\s+(?:code|description|doc)|see\s+(?:above|below|code|name)\W*$|self[- ]explanatory\W*$|same as above\W*$|as the name (?:says|suggests|implies)\W*$)",
    re.I,
)
_EMPTY_WORDS = frozenset(
    "a an the this that these those is are was be it its of for to in on at by and or with from as do does did done method function func fn procedure routine constructor class helper object "
    "member handler implementation internal private public simple main util utility operation here which will just given some any all one".split()
)
_WORD = re.compile(r"[^\W\d_]+(?:['\u2019][^\W\d_]+)?")
_HUMP = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z\u00df-\u00ff]+|\d+")
_FIELD_LINE = re.compile(
    r"^\s*[:@\\](?:(params?|parameters?|args?|arguments?|raises?|throws|exceptions?|keyword|type|var|ivar|cvar)|returns?|rtype|yields?|see|since|author|template|deprecated|override|inheritdoc)\b"
    r"[ \t]*(?:\{[^}]*\})?[ \t]*(.*)$",
    re.I,
)


def _field(line: str) -> str | None:
    """What a field line says beside its parameter's name; None if the line is none."""
    m = _FIELD_LINE.match(line)
    if not m:
        return None
    rest = m[2].strip()
    if line.lstrip()[0] == ":":
        return rest.partition(":")[2].strip() if ":" in rest else ""
    if m[1]:
        rest = re.sub(r"^[\w$.*\[\]=]+", "", rest, count=1)
    return rest.strip(" \t:-")


_SECTION = re.compile(r"^\s*(?:args|arguments|parameters|params|returns?|raises|yields?|throws|attributes|keyword args|keyword arguments|other parameters)\s*:?\s*$", re.I)
_CODE = re.compile(
    r"^\s*(?:@\w[\w.]*(?:\(.*\))?$|(?:async\s+)?def\s+\w+\s*\(.*|class\s+\w+\s*(?:\(.*\))?\s*[:{]$|return\b(?:\s+[\w.\[\]()'\",+*/-]*|\s+\S.*;)?$|(?:el)?if\b.*:$|else\s*:$|else\s*\{$|try\s*[:{]$|except\b.*:$|for\b.*:$|while\b.*:$|with\b.*:$|"
    r"import\s+[\w.,{} *]+(?:;|from.*)?$|from\s+[\w.]+\s+import\b.*|(?:const|let|var)\s+\w+.*|(?:pass|break|continue)\s*;?$|[\w.\[\]'\"]+\s*(?:[-+*/|&^%]|//|\*\*)?=\s*\S.*|[\w.]+\(.*\)\s*;?$|.*[;{]$|[})\];,]+$|"
    r"(?:public|private|protected|static|final|void|int|function)\s+\w+.*[({;].*|raise\s+\w+.*|assert\s+\w+.*|print\s*\(.*|(?:if|for|while|switch|catch)\s*\(.*)\s*$"
)


def _stem(w: str) -> str:
    w, before = w.lower(), ""
    while w != before:
        before = w
        for end in ("ations", "ation", "ings", "ing", "ies", "ied", "ers", "er", "ed", "es", "s", "e", "y"):
            if w.endswith(end) and len(w) - len(end) >= 3:
                w = w[: -len(end)]
                break
    return w[:-1] if len(w) > 3 and w[-1] == w[-2] else w


def _bare(name: str) -> set[str]:
    return {_stem(h) for h in _HUMP.findall(name)} | {name.lower().strip("_")}


def trivial(documentation: str | None, name: str) -> str:
    """Why the documentation does not inform ('' if it does).

    Null and empty texts are 'empty'.  Fields such as ``:param x:`` count only by what they say.
    """
    if not documentation or not documentation.strip():
        return "empty"
    lines = [l for l in documentation.split("\n") if l.strip()]
    if not any(c.isalnum() for c in documentation):
        return "divider"
    kept = [l for l in lines if not DIRECTIVES.match(l.strip().lstrip("#/*! "))]
    if not kept:
        return "directive"
    lines = kept
    code = sum(bool(_CODE.match(l)) for l in lines)
    if code and code * 2 > len(lines) or code == len(lines):
        return "code"
    if PLACEHOLDER.match(lines[0].strip()):
        return "placeholder"
    said, bare = [], False
    for l in lines:
        field = _field(l)
        if field is not None:
            bare = True
            if len(_WORD.findall(field)) > 1:
                said.append(field)
        elif _SECTION.match(l) or re.match(r"^\s*[-=~]{3,}\s*$", l):
            bare = True
        elif bare and re.match(r"^\s*\**\w+(?:\s*\([\w\[\], .|]+\))?\s*:?\s*(?:[\w\[\], .|]{0,30})?$", l) and len(_WORD.findall(l)) <= 3 and not l.rstrip().endswith("."):
            continue
        else:
            said.append(l)
    text = " ".join(said)
    words = _WORD.findall(text)
    if bare and not words:
        return "parameters"
    if len(re.findall(r"\w*[^\W\d_]\w*(?:['\u2019]\w+)?", text)) < 3:
        return "short"
    known = _bare(name)
    pieces = [h for w in re.findall(r"\w+", text) for h in ([w] if w.lower() in _EMPTY_WORDS else _HUMP.findall(w) or [w])]
    if all(h.lower() in _EMPTY_WORDS or _stem(h) in known or h.lower() in known or h.isdigit() for h in pieces):
        return "name"
    return ""


# --------------------------------------------------------------------------- operator
def _each(repo_id, file_path: str, content: str) -> Iterator[tuple]:
    from .lexing import lex
    from .syntax import syntax_errors

    ending = file_path.rpartition(".")[2]
    if not content:
        return
    bom = content[0] == "\ufeff"
    lexed = lex(content[1:] if bom else content, ending)
    text = content[1:] if bom else content
    found = [(*f, why) for f in deeply(lambda: list(extract(text, ending, lexed)), []) if not (why := trivial(f[4], f[0]))]
    if not found or syntax_errors(ending, text, lexed):
        return
    for name, line, start, end, documentation, source, _ in found:
        yield repo_id, file_path, ending, name, line, start + bom, end + bom, text[start:end].strip(), documentation, source


def documented_functions(chunks: DataFrame) -> DataFrame:
    """One row per named function or method whose documentation informs, in valid .py, .js and .java files.

    start and end are offsets of the unit up to the end of its header; code is that text.  Files that do
    not parse give no rows, nor do null or empty texts.
    """
    from .files import files, map_rows

    return map_rows(
        files(chunks, ("py", "js", "java")),
        _each,
        "repo_id INT, file_path STRING, language STRING, func_name STRING, def_line INT, start INT, end INT, code STRING, documentation STRING, doc_source STRING",
    )


def with_summaries(functions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each function beside the summary of the chunk that holds its line, where the summary says something.

    The join is on the file; a chunk's lines are its own, so at most one chunk holds a line.
    """
    from .files import distinct_chunks

    said = lambda c: F.when(F.length(F.trim(c)) > 0, F.trim(c))
    clean = lambda c: F.when(~F.coalesce(said(c), F.lit("todo")).rlike(r"(?i)^\W*(?:to-?do|tbd|n/?a|none|null|placeholder|fix-?me|summary|description|\.\.\.|)\W*$"), said(c))
    summaries = distinct_chunks(chunks.withColumn("content", F.lit(None).cast("string")), "start_line", "end_line", "summary").select(
        "repo_id", "file_path", "start_line", "end_line", clean(F.col("summary.short_description")).alias("short_description"), clean(F.col("summary.long_description")).alias("long_description")
    )
    s = summaries.where("short_description IS NOT NULL OR long_description IS NOT NULL").alias("s")
    f = functions.alias("f")
    on = F.col("f.repo_id").eqNullSafe(F.col("s.repo_id")) & (F.col("f.file_path") == F.col("s.file_path")) & F.col("f.def_line").between(F.col("s.start_line"), F.col("s.end_line"))
    return f.join(s, on, "left").select("f.*", "s.short_description", "s.long_description")
