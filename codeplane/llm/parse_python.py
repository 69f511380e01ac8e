"""Syntax of Python 3: recursive descent over statements, precedence climbing over expressions.

``check`` walks the logical lines of a file.  A logical line is parsed as its string of token
kinds, and the outcome is remembered, so a shape that was met before costs one dictionary
lookup.  After an error the parser resumes at the next logical line (panic mode), so that all
errors of a file are reported, the first being the cause.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

from .depth import deeply
from .lexing import PY_WORDS as W
from .lexing import Lexed, lex

EXPR_END = set(")]},:;=GA?") | {W["if"], W["else"], W["for"], W["async"], W["as"], W["from"], W["import"], "W"}
SOFT = {W["match"], W["case"], W["type"]}
NAMES = {"n"} | SOFT
# Binding power of Python's binary operators.
POWER = {W["or"]: 1, W["and"]: 2, "E": 4, W["in"]: 4, W["is"]: 4, W["not"]: 4, "|": 5, "^": 6, "&": 7, "L": 8, "R": 8, "+": 9, "-": 9, "*": 10, "/": 10, "D": 10, "%": 10, "@": 10, "P": 12}
CONSTANTS = {"0", W["None"], W["True"], W["False"]}
STRINGS = {"s", "f", "b"}
# What an expression may be assigned to: 0 nothing, 1 a name, 2 an attribute or item, 3 a display of targets, 4 a starred target.
NOT, NAME, PART, SEVERAL, STAR = range(5)


class Bad(Exception):
    def __init__(self, at: int, why: str):
        self.at, self.why = at, why


class Line:
    """One logical line; s is its kinds, without comments, line ends and continuations."""

    def __init__(self, s: str):
        self.s, self.i, self.deep = s + "\0", 0, 0

    def bad(self, why: str = "invalid syntax"):
        raise Bad(self.i, why)

    def take(self, kind: str, why: str = ""):
        if self.s[self.i] != kind:
            self.bad(why or f"expected {chr(39)}{kind if kind.isascii() else 'keyword'}{chr(39)}")
        self.i += 1

    def got(self, kind: str) -> bool:
        if self.s[self.i] == kind:
            self.i += 1
            return True
        return False

    def word(self, w: str) -> bool:
        return self.got(W[w])

    def name(self):
        if self.s[self.i] not in NAMES:
            self.bad("expected a name")
        self.i += 1

    # ------------------------------------------------------------ expressions
    def binary(self, least: int = 0) -> int:
        s = self.s
        k = s[self.i]
        if k == W["not"]:
            if least > 3:
                self.bad()
            self.i += 1
            self.binary(3)
            out = NOT
        elif k in "+-~":
            self.i += 1
            self.binary(11)
            out = NOT
        elif k == W["await"]:
            self.i += 1
            self.primary()
            out = NOT
        else:
            out = self.primary()
        while True:
            k = s[self.i]
            p = POWER.get(k)
            if p is None or p < least:
                return out
            if k == W["not"]:
                if s[self.i + 1] != W["in"]:
                    return out
                self.i += 1
            elif k == W["is"] and s[self.i + 1] == W["not"]:
                self.i += 1
            self.i += 1
            self.binary(11 if k == "P" else p + 1)
            out = NOT

    def test(self) -> int:
        if self.s[self.i] == W["lambda"]:
            self.i += 1
            self.parameters(":", False)
            self.take(":")
            self.test()
            return NOT
        out = self.binary()
        if self.word("if"):
            self.binary()
            if not self.word("else"):
                self.bad("expected 'else' after 'if' expression")
            self.test()
            return NOT
        return out

    def named(self) -> int:
        if self.s[self.i] in NAMES and self.s[self.i + 1] == "W":
            self.i += 2
            self.test()
            return NOT
        return self.test()

    def starred(self, named: bool = True) -> int:
        if self.got("*"):
            return STAR if self.binary(5) else NOT
        return self.named() if named else self.test()

    def sequence(self, closers: str, named: bool = False) -> int:
        """One or more expressions; with a comma, a tuple."""
        out = self.starred(named)
        if self.s[self.i] != ",":
            return out
        good = out != NOT
        while self.got(","):
            k = self.s[self.i]
            if k in closers or k in "\0=G;" or k in (W["in"], ):
                break
            good &= self.starred(named) != NOT
        return SEVERAL if good else NOT

    def comprehension(self) -> bool:
        found = False
        while self.s[self.i] in (W["for"], W["async"]):
            found = True
            self.word("async")
            if not self.word("for"):
                self.bad()
            self.targets()
            if not self.word("in"):
                self.bad()
            self.binary()
            if self.word("if"):  # the rest of a conditional belongs to the source
                self.i -= 1
            while self.word("if"):
                if self.s[self.i] in NAMES and self.s[self.i + 1] == "W":
                    self.i += 2
                self.binary() if self.s[self.i] != W["lambda"] else self.test()
        return found

    def targets(self):
        """Targets of a for: no comparison with 'in' may be read."""
        while True:
            self.got("*")
            if self.primary() == NOT:
                self.bad("cannot assign to this expression here")
            if not self.got(","):
                return
            if self.s[self.i] == W["in"]:
                return

    def primary(self) -> int:
        s = self.s
        self.deep += 1
        k = s[self.i]
        if k in NAMES:
            self.i += 1
            out = NAME
        elif k in STRINGS:
            byte = k == "b"
            while s[self.i] in STRINGS:
                if (s[self.i] == "b") != byte:
                    self.bad("cannot mix bytes and nonbytes literals")
                self.i += 1
            out = NOT
        elif k in CONSTANTS:
            self.i += 1
            out = NOT
        elif k == "(":
            self.i += 1
            if self.got(")"):
                out = SEVERAL
            elif s[self.i] == W["yield"]:
                self.yielded(")")
                self.take(")", "'(' was never closed")
                out = NOT
            else:
                out = self.starred()
                if self.comprehension():
                    out = NOT
                elif s[self.i] == ",":
                    good = out != NOT
                    while self.got(","):
                        if s[self.i] == ")":
                            break
                        good &= self.starred() != NOT
                    out = SEVERAL if good else NOT
                elif out == STAR:
                    self.bad("cannot use starred expression here")
                self.take(")", "'(' was never closed")
        elif k == "[":
            self.i += 1
            out = SEVERAL
            if not self.got("]"):
                good = self.starred() != NOT
                if self.comprehension():
                    good = False
                while self.got(","):
                    if s[self.i] == "]":
                        break
                    good &= self.starred() != NOT
                self.take("]", "'[' was never closed")
                out = SEVERAL if good else NOT
        elif k == "{":
            self.braces()
            out = NOT
        else:
            self.bad()
        while True:
            k = s[self.i]
            if k == "(":
                self.i += 1
                self.arguments()
                out = NOT
            elif k == "[":
                self.i += 1
                self.subscript()
                while self.got(","):
                    if s[self.i] == "]":
                        break
                    self.subscript()
                self.take("]", "'[' was never closed")
                out = PART
            elif k == ".":
                self.i += 1
                self.name()
                out = PART
            else:
                self.deep -= 1
                return out

    def subscript(self):
        if self.s[self.i] == "*":
            self.starred()
            return
        if self.s[self.i] != ":":
            self.named()
            if self.s[self.i] != ":":
                return
        for _ in range(2):
            if self.got(":") and self.s[self.i] not in ":],":
                self.test()

    def braces(self):
        self.take("{")
        if self.got("}"):
            return
        first = True
        kind = None
        while True:
            if self.got("P"):
                self.binary(5)
                new = "dict"
            elif self.s[self.i] == "*":
                self.starred()
                new = "set"
            else:
                self.named()
                new = "set"
                if self.got(":"):
                    new = "dict"
                    self.test()
            if kind and new != kind:
                self.bad("':' expected after dictionary key")
            kind = new
            if first and self.comprehension():
                break
            first = False
            if not self.got(",") or self.s[self.i] == "}":
                break
        self.take("}", "'{' was never closed")

    def arguments(self):
        keyword = unpacked = False
        first = True
        while self.s[self.i] != ")":
            if self.got("*"):
                self.test()
                if unpacked:
                    self.bad("iterable argument unpacking follows keyword argument unpacking")
            elif self.got("P"):
                self.test()
                unpacked = True
            elif self.s[self.i] in NAMES and self.s[self.i + 1] == "=":
                self.i += 2
                self.test()
                keyword = True
            else:
                at = self.i
                self.named()
                if self.s[self.i] in (W["for"], W["async"]):
                    self.comprehension()
                    if not first or self.s[self.i] != ")":
                        self.bad("Generator expression must be parenthesized")
                elif keyword or unpacked:
                    self.i = at
                    self.bad("positional argument follows keyword argument")
            first = False
            if not self.got(","):
                break
        self.take(")", "'(' was never closed")

    def yielded(self, closers: str):
        self.take(W["yield"])
        if self.word("from"):
            self.test()
        elif self.s[self.i] not in closers and self.s[self.i] not in "\0;=)":
            self.sequence(closers)

    def parameters(self, end: str, typed: bool):
        """Parameters of a def (typed) or lambda, up to end, which is not taken."""
        default = star = bare = slash = False
        any_before = False
        while self.s[self.i] != end:
            if self.got("P"):
                self.name()
                if typed and self.got(":"):
                    self.test()
                if bare:
                    self.bad("named arguments must follow bare *")
                self.got(",")
                if self.s[self.i] != end:
                    self.bad("arguments cannot follow var-keyword argument")
                return
            if self.got("*"):
                if star:
                    self.bad("* argument may appear only once")
                star = True
                if self.s[self.i] in NAMES:
                    self.i += 1
                    if typed and self.got(":"):
                        self.starred(False)
                else:
                    bare = True
            elif self.got("/"):
                if slash or star or not any_before:
                    self.bad("/ may appear only once")
                slash = True
            else:
                self.name()
                bare = False
                if typed and self.got(":"):
                    self.test()
                if self.got("="):
                    self.test()
                    default = True
                elif default and not star:
                    self.bad("parameter without a default follows parameter with a default")
            any_before = True
            if not self.got(","):
                break
        if bare:
            self.bad("named arguments must follow bare *")
        if self.s[self.i] != end:
            self.bad()

    # ------------------------------------------------------------- statements
    def simple(self):
        s = self.s
        k = s[self.i]
        if k in NAMES and not (k == W["type"] and s[self.i + 1] in NAMES):
            self.expression()
        elif k == W["return"]:
            self.i += 1
            if s[self.i] not in "\0;":
                self.sequence("")
        elif k in (W["pass"], W["break"], W["continue"]):
            self.i += 1
        elif k == W["raise"]:
            self.i += 1
            if s[self.i] not in "\0;":
                self.test()
                if self.word("from"):
                    self.test()
        elif k == W["import"]:
            self.i += 1
            while True:
                self.dotted()
                if self.word("as"):
                    self.name()
                if not self.got(","):
                    break
        elif k == W["from"]:
            self.i += 1
            dots = 0
            while s[self.i] == "." or s[self.i] == "0" and s[self.i + 1] in (W["import"], "n", ".", "0"):
                self.i += 1
                dots += 1
            if not (dots and s[self.i] == W["import"]):
                self.dotted()
            if not self.word("import"):
                self.bad()
            if self.got("*"):
                return
            closed = self.got("(")
            while True:
                self.name()
                if self.word("as"):
                    self.name()
                if not self.got(","):
                    break
                if closed and s[self.i] == ")":
                    break
            if closed:
                self.take(")", "'(' was never closed")
        elif k in (W["global"], W["nonlocal"]):
            self.i += 1
            self.name()
            while self.got(","):
                self.name()
        elif k == W["assert"]:
            self.i += 1
            self.test()
            if self.got(","):
                self.test()
        elif k == W["del"]:
            self.i += 1
            if self.sequence("") in (NOT, STAR):
                self.bad("cannot delete expression")
        elif k == W["type"]:
            self.i += 1
            self.name()
            if s[self.i] == "[":
                self.type_parameters()
            self.take("=")
            self.test()
        else:
            self.expression()

    def dotted(self):
        self.name()
        while self.got("."):
            self.name()

    def type_parameters(self):
        self.take("[")
        while self.s[self.i] != "]":
            if not self.got("*"):
                self.got("P")
            self.name()
            if self.got(":"):
                self.test()
            if self.got("="):
                self.starred()
            if not self.got(","):
                break
        self.take("]")

    def expression(self):
        s = self.s
        if s[self.i] == W["yield"]:
            self.yielded("")
            return
        parenthesised = s[self.i] == "("
        out = self.sequence("")
        if s[self.i] == ":":
            if out not in (NAME, PART) or parenthesised and out == SEVERAL:
                self.bad("illegal target for annotation")
            self.i += 1
            self.test()
            if self.got("="):
                self.yielded("") if s[self.i] == W["yield"] else self.sequence("")
        elif s[self.i] == "G":
            if out not in (NAME, PART):
                self.bad("illegal expression for augmented assignment")
            self.i += 1
            self.yielded("") if s[self.i] == W["yield"] else self.sequence("")
        else:
            if s[self.i] == "=" and out == STAR:
                self.bad("starred assignment target must be in a list or tuple")
            while s[self.i] == "=":
                if out == NOT:
                    self.bad("cannot assign to expression")
                self.i += 1
                if s[self.i] == W["yield"]:
                    self.yielded("")
                    return
                out = self.sequence("")
            if out == STAR:
                self.bad("can't use starred expression here")

    def block(self) -> bool:
        """After a header: ':' and either the end (an indented block follows) or simple statements."""
        self.take(":", "expected ':'")
        if self.s[self.i] == "\0":
            return True
        self.statements()
        return False

    def statements(self):
        while True:
            self.simple()
            if not self.got(";") or self.s[self.i] == "\0":
                break
        if self.s[self.i] != "\0":
            self.bad()

    def pattern(self):
        """A case pattern, alternatives and 'as' included."""
        while True:
            self.closed_pattern()
            if not self.got("|"):
                break
        if self.word("as"):
            self.name()

    def closed_pattern(self):
        s = self.s
        k = s[self.i]
        if k in NAMES:
            self.dotted()
            if self.got("("):
                self.pattern_list(")", True)
        elif k in ("0", "-"):
            self.got("-")
            self.take("0")
            if s[self.i] in "+-":
                self.i += 1
                self.take("0")
        elif k in STRINGS:
            while s[self.i] in STRINGS:
                self.i += 1
        elif k in CONSTANTS:
            self.i += 1
        elif self.got("("):
            self.pattern_list(")", False)
        elif self.got("["):
            self.pattern_list("]", False)
        elif self.got("{"):
            while s[self.i] != "}":
                if self.got("P"):
                    self.name()
                else:
                    self.closed_pattern()
                    self.take(":")
                    self.pattern()
                if not self.got(","):
                    break
            self.take("}")
        else:
            self.bad()

    def pattern_list(self, end: str, keyword: bool):
        while self.s[self.i] != end:
            if keyword and self.s[self.i] in NAMES and self.s[self.i + 1] == "=":
                self.i += 2
                self.pattern()
            elif self.got("*"):
                self.name()
            else:
                self.pattern()
            if not self.got(","):
                break
        self.take(end)

    def line(self) -> tuple[str, bool]:
        """The keyword that begins a compound statement, or '', and whether a block must follow."""
        s = self.s
        k = s[0]
        if k == "@":
            self.i = 1
            self.named()
            if s[self.i] != "\0":
                self.bad()
            return "@", False
        if k == W["async"]:
            self.i = 1
            if s[1] not in (W["def"], W["with"], W["for"]):
                self.bad()
            k = s[1]
        if k == W["def"]:
            self.i += 1
            self.name()
            if s[self.i] == "[":
                self.type_parameters()
            self.take("(", "expected '('")
            self.parameters(")", True)
            self.take(")", "'(' was never closed")
            if self.got("A"):
                self.test()
            return "def", self.block()
        if k == W["class"]:
            self.i += 1
            self.name()
            if s[self.i] == "[":
                self.type_parameters()
            if self.got("("):
                self.arguments()
            return "class", self.block()
        if k in (W["if"], W["elif"], W["while"]):
            self.i += 1
            self.named()
            return ("if" if k == W["if"] else "elif" if k == W["elif"] else "while"), self.block()
        if k in (W["else"], W["finally"], W["try"]):
            self.i += 1
            return ("else" if k == W["else"] else "finally" if k == W["finally"] else "try"), self.block()
        if k == W["for"]:
            self.i += 1
            self.targets()
            if not self.word("in"):
                self.bad()
            self.sequence(":", True)
            return "for", self.block()
        if k == W["except"]:
            self.i += 1
            star = self.got("*")
            if s[self.i] != ":" or star:
                self.test()
                if s[self.i] == ",":
                    self.bad("multiple exception types must be parenthesized")
                if self.word("as"):
                    self.name()
            return "except", self.block()
        if k == W["with"]:
            self.i += 1
            at = self.i
            try:
                self.take("(")
                self.with_items(")")
                self.take(")")
                if s[self.i] != ":":
                    self.bad()
            except Bad:
                self.i = at
                self.deep = 0
                self.with_items(":")
            return "with", self.block()
        if k in (W["match"], W["case"]) and s[-2] == ":" and s[1] not in "=.:,GW":
            at = self.i
            try:
                self.i = 1
                if k == W["match"]:
                    self.sequence(":", True)
                else:
                    if self.got("*"):
                        self.name()
                    else:
                        self.pattern()
                    while self.got(","):
                        if s[self.i] in (":", W["if"]):
                            break
                        if self.got("*"):
                            self.name()
                        else:
                            self.pattern()
                    if self.word("if"):
                        self.named()
                if s[self.i] != ":":
                    self.bad()
                return ("match" if k == W["match"] else "case"), self.block()
            except Bad:
                self.i, self.deep = at, 0
        elif k == W["case"] and s[1] not in "=.:,GW(\0;":
            self.i = 1
            self.pattern()
            if self.word("if"):
                self.named()
            return "case", self.block()
        self.statements()
        return "", False

    def with_items(self, end: str):
        while True:
            self.test()
            if self.word("as"):
                if self.s[self.i] == "(":
                    self.primary()
                elif self.primary() == NOT:
                    self.bad("cannot assign to expression")
            if not self.got(","):
                return
            if self.s[self.i] == end:
                if end == ":":
                    self.bad()
                return


@lru_cache(maxsize=300_000)
def shape(s: str) -> tuple[str, bool, int, str]:
    """(keyword, a block must follow, offset of the error or -1, the error) of a logical line."""
    line = Line(s)
    try:
        keyword, opens = line.line()
        return keyword, opens, -1, ""
    except Bad as e:
        return "", s.endswith(":"), min(e.at, len(s)), e.why


@lru_cache(maxsize=300_000)
def depth(s: str) -> tuple[int, str]:
    """Net bracket depth of one physical line that starts outside brackets; the first mismatch."""
    stack = []
    for k in s:
        if k in "([{":
            stack.append(k)
        elif k in ")]}":
            if not stack:
                return 0, f"unmatched '{k}'"
            if "([{".index(stack.pop()) != ")]}".index(k):
                return 0, f"closing parenthesis '{k}' does not match"
    return len(stack), ""


_FIELD = re.compile(r"\{\{|\}\}|[{}]")


@lru_cache(maxsize=100_000)
def fields(token: str) -> str:
    """The error in the replacement fields of an f-string, if any."""
    t = token.lstrip(" \t\f")
    m = re.match(r"[a-zA-Z]*(\"\"\"|'''|\"|')", t)
    body = t[m.end() : -len(m[1])]
    if "{" not in body and "}" not in body:
        return ""
    i, n = 0, len(body)
    while i < n:
        c = body[i]
        if c == "{":
            if body[i + 1 : i + 2] == "{":
                i += 2
                continue
            level, j = 1, i + 1
            quote = ""
            while j < n and level:
                d = body[j]
                if quote:
                    if d == quote:
                        quote = ""
                elif d in "'\"":
                    quote = d
                elif d in "([{":
                    level += 1
                elif d in ")]}":
                    level -= 1
                j += 1
            if level:
                return "f-string: expecting '}'"
            inner = body[i + 1 : j - 1]
            if not inner.strip():
                return "f-string: valid expression required before '}'"
            s = lex("(" + inner + ")", "py").kinds.replace("\n", "").replace("N", "").replace("#", "")
            line = Line(s[1:-1])
            try:
                line.yielded("") if line.s[0] == W["yield"] else line.sequence(":!=", True)
                if line.s[line.i] not in "\0:=?!":
                    return "f-string: invalid syntax"
            except Bad as e:
                if line.s[min(e.at, len(line.s) - 1)] not in "?":
                    return "f-string: invalid syntax"
            i = j
        elif c == "}":
            if body[i + 1 : i + 2] != "}":
                return "f-string: single '}' is not allowed"
            i += 2
        else:
            i += 1
    return ""


#: What may precede a clause at the same indentation.
FOLLOWS = {"elif": ("if", "elif"), "else": ("if", "elif", "for", "while", "except"), "except": ("try", "except"), "finally": ("try", "except", "else")}


_EMPTY: tuple = ("",)
_BRACKETS = frozenset("()[]{}")
#: Outcomes of physical lines that are logical lines, by kinds; no entries are added beyond the bound.
_LINES: dict[str, tuple] = {}
REMEMBERED = 300_000


def _remember(raw: str, outcome: tuple):
    if len(_LINES) < REMEMBERED:
        _LINES[raw] = outcome


def check(text: str, lexed: Lexed | None = None) -> list[tuple[int, str]]:
    """All syntax errors as (line, what), in order of line; an empty list for a valid file."""
    return deeply(lambda: _check(text, lexed), [])


def _check(text: str, lexed: Lexed | None) -> list[tuple[int, str]]:
    if text[:1] == "\ufeff":
        text, lexed = text[1:], None
    if "\0" in text:
        return [(text.count("\n", 0, text.index("\0")) + 1, "source code cannot contain null bytes")]
    x = lexed or lex(text, "py")
    kinds = x.kinds.replace("N", "\n")
    errors: list[tuple[int, str]] = []
    ends: list[int] = []

    def line_of(token: int) -> int:
        if not ends:
            ends.extend(m.start() for m in re.finditer("\n", text))
        at = x.start(min(token, len(x.tokens) - 1)) if x.tokens else 0
        return bisect_left(ends, at) + 1

    if "f" in kinds:
        at = kinds.find("f")
        while at >= 0:
            if (t := x.tokens[at]) and ("{" in t or "}" in t) and (why := fields(t)):
                errors.append((line_of(at), why))
            at = kinds.find("f", at + 1)
    tokens = x.tokens
    stack = [""]  # indentations
    last = [""]  # the keyword of the last statement at each indentation
    opener = ["module"]  # what opened each block
    expects = False
    header = ""
    at = 0  # token index of the line's first token
    pending, pending_at, level = "", 0, 0
    indent = ""
    if tokens and kinds[0] != "\n":
        t = tokens[0]
        indent = t[: len(t) - len(t.lstrip(" \t\f"))]
    for raw in kinds.split("\n"):
        start = at
        at += len(raw) + 1
        own = indent
        if at <= len(tokens):
            t = tokens[at - 1]
            indent = t[max(t.rfind("\n"), t.rfind("\r")) + 1 :]
        if not pending and (known := _LINES.get(raw)) is not None:
            if known is _EMPTY:
                continue
            s, keyword, opens, wrong, why = known
        else:
            s = raw.replace("#", "") if "#" in raw else raw
            whole = not pending
            if pending:
                s = pending + s
                start = pending_at
                own = pending_indent
            elif not s:
                _remember(raw, _EMPTY)
                continue
            if "\\" in s:
                s = s.replace("\\", "")
                if not s:
                    continue
            if not _BRACKETS.isdisjoint(s):
                level, why = depth(s)
                if why:
                    errors.append((line_of(start), why))
                    pending = ""
                    last[-1] = ""
                    expects = s[-1:] == ":"
                    continue
                if level:
                    if not pending:
                        pending_at, pending_indent = start, own
                    pending = s
                    continue
            pending = ""
            keyword, opens, wrong, why = shape(s)
            if whole:
                _remember(raw, (s, keyword, opens, wrong, why))
        # indentation
        top = stack[-1]
        if own != top and (own := own.replace("\f", "")) != top:
            if len(own) > len(top) and own.startswith(top):
                if expects:
                    stack.append(own)
                    last.append("")
                    opener.append(header)
                else:
                    errors.append((line_of(start), "unexpected indent"))
                    stack.append(own)
                    last.append("")
                    opener.append("")
            elif own in stack:
                if expects:
                    errors.append((line_of(start), "expected an indented block"))
                while stack[-1] != own:
                    if last[-1] == "try":
                        errors.append((line_of(start), "expected 'except' or 'finally' block"))
                    stack.pop()
                    last.pop()
                    opener.pop()
            else:
                a, b = own.expandtabs(8), top.expandtabs(8)
                if len(a) == len(b) or "\t" in own + top and (len(a) > len(b)) != (len(own.expandtabs(1)) > len(top.expandtabs(1))):
                    errors.append((line_of(start), "inconsistent use of tabs and spaces in indentation"))
                elif len(a) > len(b):
                    if expects:
                        stack.append(own)
                        last.append("")
                        opener.append(header)
                    else:
                        errors.append((line_of(start), "unexpected indent"))
                else:
                    errors.append((line_of(start), "unindent does not match any outer indentation level"))
                    while len(stack) > 1 and len(stack[-1].expandtabs(8)) > len(a):
                        stack.pop()
                        last.pop()
                        opener.pop()
        elif expects:
            errors.append((line_of(start), "expected an indented block"))
        expects, header = opens, keyword
        if wrong >= 0:
            skipped = 0
            token = start
            # an error at the end of the line is one of its last token
            while token < len(tokens) and skipped < min(wrong, len(s) - 1):
                skipped += kinds[token] not in "\n#\\"
                token += 1
            while token < len(tokens) - 1 and kinds[token] in "\n#\\":
                token += 1
            errors.append((line_of(token), why))
            last[-1] = ""
            keyword = "?"
        else:
            before = last[-1]
            if keyword in FOLLOWS:
                if before not in FOLLOWS[keyword] and before != "?":
                    errors.append((line_of(start), f"'{keyword}' follows nothing it could belong to"))
            elif before == "try":
                errors.append((line_of(start), "expected 'except' or 'finally' block"))
            elif before == "@" and keyword not in ("@", "def", "class"):
                errors.append((line_of(start), "a decorator must precede a function or class"))
            if keyword == "case" and opener[-1] not in ("match", ""):
                errors.append((line_of(start), "'case' outside 'match'"))
            elif opener[-1] == "match" and keyword not in ("case", ""):
                errors.append((line_of(start), "expected 'case'"))
        last[-1] = keyword
    if pending:
        errors.append((line_of(pending_at), "a bracket was never closed"))
    elif expects:
        errors.append((text.count("\n") + 1, "expected an indented block"))
    elif "try" in last:
        errors.append((text.count("\n") + 1, "expected 'except' or 'finally' block"))
    elif last[-1] == "@":
        errors.append((text.count("\n") + 1, "a decorator must precede a function or class"))
    errors.sort()
    return errors
