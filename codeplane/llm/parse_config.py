"""Syntax of JSON (RFC 8259), TOML 1.0 and YAML by recursive descent with recovery at the next entry or line.

The JSON and TOML parsers also report every leaf as (key path, start, end) with offsets into the
text, which is what the search for credentials needs; the YAML parser does so for scalars.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from .depth import deeply

Leaf = tuple[tuple[str, ...], int, int]


class Bad(Exception):
    def __init__(self, at: int, why: str):
        self.at, self.why = at, why


# ----------------------------------------------------------------------------- JSON
_J_WS = re.compile(r"[ \t\r\n]*")
_J_STRING = re.compile(r'"((?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+)"')
_J_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?(?![\w.])", re.A)
_J_WORD = re.compile(r"(?:true|false|null)\b")
_J_AGAIN = re.compile(r'[\[{"]')


class Json:
    def __init__(self, text: str):
        self.t, self.i, self.errors, self.leaves = text, 0, [], []

    def ws(self) -> str:
        self.i = _J_WS.match(self.t, self.i).end()
        return self.t[self.i : self.i + 1]

    def value(self, path: tuple[str, ...]):
        c = self.ws()
        if c == "{":
            self.object(path)
        elif c == "[":
            self.array(path)
        else:
            m = (_J_STRING if c == '"' else _J_WORD if c.isalpha() else _J_NUMBER).match(self.t, self.i)
            if not m:
                raise Bad(self.i, "expected a value")
            own = 1 if c == '"' else 0
            self.leaves.append((path, m.start() + own, m.end() - own))
            self.i = m.end()

    def entries(self, end: str, each):
        """Entries up to the closing bracket; after an error, goes on behind the next comma of the same level."""
        self.i += 1
        if self.ws() == end:
            self.i += 1
            return
        while True:
            try:
                each()
                c = self.ws()
                if c == end:
                    self.i += 1
                    return
                if c != ",":
                    raise Bad(self.i, f"expected ',' or '{end}'")
                self.i += 1
            except Bad as e:
                self.errors.append((e.at, e.why))
                if not self.recover(end):
                    return

    def recover(self, end: str) -> bool:
        """Moves behind the next comma at this level (True) or the closing bracket (False)."""
        level = 0
        for m in re.compile(r'"(?:[^"\\\n]|\\.)*"|[\[\]{},]').finditer(self.t, self.i):
            c = m[0]
            if c in "[{":
                level += 1
            elif c in "]}":
                if not level:
                    self.i = m.end()
                    return False
                level -= 1
            elif c == "," and not level:
                self.i = m.end()
                return True
        self.i = len(self.t)
        return False

    def object(self, path):
        def each():
            self.ws()
            m = _J_STRING.match(self.t, self.i)
            if not m:
                raise Bad(self.i, "expected a property name in double quotes")
            self.i = m.end()
            if self.ws() != ":":
                raise Bad(self.i, "expected ':'")
            self.i += 1
            self.value((*path, m[1]))

        self.entries("}", each)

    def array(self, path):
        n = [0]

        def each():
            self.value((*path, str(n[0])))
            n[0] += 1

        self.entries("]", each)


def _json(text: str) -> tuple[list[tuple[int, str]], list[Leaf]]:
    p = Json(text)
    try:
        p.value(())
        if p.ws():
            p.errors.append((p.i, "extra data"))
    except Bad as e:
        p.errors.append((e.at, e.why))
    errors = [*p.errors]
    while p.ws():  # what the last error covers has leaves too
        at = p.i
        try:
            p.value(())
        except Bad:
            m = _J_AGAIN.search(p.t, max(at + 1, p.i))
            p.i = m.start() if m else len(p.t)
    return errors, p.leaves


# ----------------------------------------------------------------------------- TOML
_T_WS = re.compile(r"[ \t]*")
_T_KEY = re.compile(r"[A-Za-z0-9_-]+")
_T_BASIC = re.compile(r'"((?:[^"\\\x00-\x08\x0a-\x1f\x7f]++|\\(?:[btnfr"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*+)"')
_T_LITERAL = re.compile(r"'([^'\x00-\x08\x0a-\x1f\x7f]*)'")
_T_BASIC3 = re.compile(r'"""((?:[^"\\\x00-\x08\x0b\x0c\x0e-\x1f\x7f]++|\\(?:[btnfr"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[ \t]*\r?\n\s*)|"{1,2}(?!"))*+)("{3,5})')
_T_LITERAL3 = re.compile(r"'''((?:[^'\x00-\x08\x0b\x0c\x0e-\x1f\x7f]++|'{1,2}(?!'))*+)('{3,5})")
_T_DATE = re.compile(r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?:[Tt ](?:[01]\d|2[0-3]):[0-5]\d:(?:[0-5]\d|60)(?:\.\d+)?(?:[Zz]|[-+](?:[01]\d|2[0-3]):[0-5]\d)?)?|(?:[01]\d|2[0-3]):[0-5]\d:(?:[0-5]\d|60)(?:\.\d+)?", re.A)
_T_NUMBER = re.compile(
    r"0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*|[-+]?(?:inf|nan)|[-+]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][-+]?\d(?:_?\d)*)?", re.A
)
_T_NEWLINE = re.compile(r"\r?\n")
_T_REST = re.compile(r"[ \t]*(?:\#[^\r\n\x00-\x08\x0b\x0c\x0e-\x1f\x7f]*)?(?:\r?\n|\Z)")
_T_BLANK = re.compile(r"(?:[ \t]|\r?\n|\#[^\r\n]*)*")


class Toml:
    def __init__(self, text: str):
        self.t, self.i, self.errors, self.leaves = text, 0, [], []
        # Key path -> "table" (named in a header), "implied", "array", "dotted" (made by a dotted key), "value", "inline".
        self.kind: dict[tuple[str, ...], str] = {(): "table"}
        self.count: dict[tuple[str, ...], int] = {}

    def ws(self) -> str:
        self.i = _T_WS.match(self.t, self.i).end()
        return self.t[self.i : self.i + 1]

    def key(self) -> tuple[str, ...]:
        out = []
        while True:
            c = self.ws()
            m = (_T_BASIC if c == '"' else _T_LITERAL if c == "'" else _T_KEY).match(self.t, self.i)
            if not m:
                raise Bad(self.i, "expected a key")
            out.append(m[1] if c in "\"'" and c else m[0])
            self.i = m.end()
            if self.ws() != ".":
                return tuple(out)
            self.i += 1

    def real(self, path: tuple[str, ...]) -> tuple[str, ...]:
        """The path with the number of the current element after each array of tables."""
        out: tuple[str, ...] = ()
        for p in path:
            out = (*out, p)
            if self.kind.get(out) == "array":
                out = (*out, f"[{self.count[out]}]")
        return out

    def header(self) -> tuple[str, ...]:
        at = self.i
        many = self.t.startswith("[[", at)
        self.i += 1 + many
        key = self.key()
        if not self.t.startswith("]]" if many else "]", self.i):
            raise Bad(self.i, "expected ']'")
        self.i += 1 + many
        parent = self.real(key[:-1])
        for n in range(1, len(key)):
            p = self.real(key[:n])
            if self.kind.setdefault(p, "implied") in ("value", "inline"):
                raise Bad(at, "a header names a key that has a value")
        full = (*parent, key[-1])
        known = self.kind.get(full)
        if many:
            if known not in (None, "array"):
                raise Bad(at, "an array of tables was defined otherwise")
            self.kind[full] = "array"
            self.count[full] = self.count.get(full, -1) + 1
            full = (*full, f"[{self.count[full]}]")
            self.kind[full] = "table"
            return full
        if known not in (None, "implied"):
            raise Bad(at, "a table is defined twice")
        self.kind[full] = "table"
        return full

    def pair(self, base: tuple[str, ...]):
        at = self.i
        key = self.key()
        if self.t[self.i : self.i + 1] != "=":
            raise Bad(self.i, "expected '=' after a key")
        self.i += 1
        p = base
        for part in key[:-1]:
            p = (*p, part)
            if self.kind.setdefault(p, "dotted") != "dotted":
                raise Bad(at, "a key is defined twice")
        p = (*p, key[-1])
        if p in self.kind:
            raise Bad(at, "a key is defined twice")
        self.ws()
        self.kind[p] = "inline" if self.t[self.i : self.i + 1] == "{" else "value"
        self.value(p)

    def value(self, path: tuple[str, ...]):
        c = self.ws()
        t, i = self.t, self.i
        if c == '"':
            m = (_T_BASIC3 if t.startswith('"""', i) else _T_BASIC).match(t, i)
        elif c == "'":
            m = (_T_LITERAL3 if t.startswith("'''", i) else _T_LITERAL).match(t, i)
        elif c == "[":
            self.i += 1
            n = 0
            while True:
                self.i = _T_BLANK.match(t, self.i).end()
                if t[self.i : self.i + 1] == "]":
                    break
                self.value((*path, str(n)))
                n += 1
                self.i = _T_BLANK.match(t, self.i).end()
                if t[self.i : self.i + 1] == ",":
                    self.i += 1
                elif t[self.i : self.i + 1] != "]":
                    raise Bad(self.i, "unclosed array")
            self.i += 1
            return
        elif c == "{":
            self.i += 1
            if self.ws() != "}":
                while True:
                    self.ws()
                    self.pair(path)
                    if self.ws() == "}":
                        break
                    if t[self.i : self.i + 1] != ",":
                        raise Bad(self.i, "unclosed inline table")
                    self.i += 1
            self.i += 1
            return
        else:
            m = re.compile(r"(?:true|false)(?![\w])").match(t, i) or _T_DATE.match(t, i) or _T_NUMBER.match(t, i)
            if m and re.compile(r"[\w+.:-]").match(t, m.end()):
                m = None
        if not m:
            raise Bad(i, "invalid value")
        q = 0 if c not in "\"'" else 3 if m.re in (_T_BASIC3, _T_LITERAL3) else 1
        self.leaves.append((path, m.start() + q, m.end() - q))
        self.i = m.end()


def _toml(text: str) -> tuple[list[tuple[int, str]], list[Leaf]]:
    p = Toml(text[1:] if text[:1] == "\ufeff" else text)
    base: tuple[str, ...] = ()
    n = len(p.t)
    while p.i < n:
        try:
            c = p.ws()
            if c == "[":
                base = p.header()
            elif c and c not in "#\r\n":
                p.pair(base)
            m = _T_REST.match(p.t, p.i)
            if not m:
                raise Bad(p.i, "expected the end of the line")
            if m.end() == p.i:
                break
            p.i = m.end()
        except Bad as e:
            p.errors.append((e.at, e.why))
            at = p.t.find("\n", max(e.at, p.i))
            p.i = n if at < 0 else at + 1
    return p.errors, p.leaves


# ----------------------------------------------------------------------------- YAML
_Y_DOUBLE = re.compile(r'"((?:[^"\\]++|\\(?:[0abt\tnvfre "/\\N_LP\r\n]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*+)"')
_Y_SINGLE = re.compile(r"'((?:[^']++|'')*+)'")
_Y_PROPERTY = re.compile(r"(?:&[^\s,\[\]{}]+|!(?:<[^>\s]*>|[^\s,\[\]{}]*))(?=[ \t\r\n]|\Z)[ \t]*")
_Y_ALIAS = re.compile(r"\*[^\s,\[\]{}]+")
_Y_PLAIN = re.compile(r"(?![-?:](?:\s|\Z)|[,\[\]{}#&*!|>'\"%@`])(?:[^\s:#]|:(?=\S)|(?<=\S)#|[ \t]+(?![#\s]))+")
_Y_FLOW_PLAIN = re.compile(r"(?![-?:](?:[\s,\[\]{}]|\Z)|[,\[\]{}#&*!|>'\"%@`])(?:[^\s:#,\[\]{}]|:(?=[^\s,\[\]{}])|(?<=\S)#|[ \t]+(?![#\s,\[\]{}:]))+")
_Y_HEADER = re.compile(r"[|>](?:[1-9][-+]?|[-+][1-9]?)?[ \t]*(?:(?<=[ \t])\#.*)?\r?$")


class Yaml:
    def __init__(self, text: str):
        self.t = text[1:] if text[:1] == "\ufeff" else text
        self.errors: list[tuple[int, str]] = []
        self.leaves: list[Leaf] = []
        self.starts = [0, *(m.end() for m in re.finditer("\n", self.t))]
        self.n = 0  # current line
        self.deep = 0

    def line(self, n: int) -> str:
        if n >= len(self.starts):
            return ""
        end = self.starts[n + 1] if n + 1 < len(self.starts) else len(self.t)
        return self.t[self.starts[n] : end].rstrip("\r\n")

    def content(self) -> tuple[int, str] | None:
        """Indentation and text of the next line with content; None at the end or a document marker."""
        while self.n < len(self.starts):
            l = self.line(self.n)
            s = l.strip(" \t")
            if s and s[0] != "#":
                if l[:3] in ("---", "...") and (len(l) == 3 or l[3] in " \t"):
                    return None
                i = len(l) - len(l.lstrip(" "))
                if l[i] == "\t" and s[0] not in "[]{},":
                    raise Bad(self.starts[self.n] + i, "a tab indents a line")
                return i, l
            self.n += 1
        return None

    def key_end(self, l: str, c: int) -> int:
        """Column of the ':' that ends an implicit key at column c of line l, or -1."""
        i = c
        while m := _Y_PROPERTY.match(l, i):
            i = m.end()
        s = l[i : i + 1]
        if s == '"':
            m = _Y_DOUBLE.match(l, i)
        elif s == "'":
            m = _Y_SINGLE.match(l, i)
        elif s == "*":
            m = _Y_ALIAS.match(l, i)
        elif s and s in "[{":
            level = 0
            for m in re.compile(r"\"(?:[^\"\\]|\\.)*\"|'[^']*'|[\[\]{}]").finditer(l, i):
                level += (m[0] in "[{") - (m[0] in "]}")
                if not level:
                    break
            else:
                return -1
        elif s == ":":
            return i if l[i + 1 : i + 2] in ("", " ", "\t") and i > c else -1
        else:
            m = _Y_PLAIN.match(l, i)
        if not m:
            return -1
        j = m.end()
        while l[j : j + 1] in (" ", "\t"):
            j += 1
        return j if l[j : j + 1] == ":" and l[j + 1 : j + 2] in ("", " ", "\t") else -1

    def block(self, least: int, path: tuple[str, ...]):
        """The block node on the next line with content, indented by at least `least`; nothing if there is none."""
        found = self.content()
        if not found or found[0] < least:
            return
        self.node_at(found[0], found[1], path, least - 1)

    def node_at(self, c: int, l: str, path: tuple[str, ...], parent: int):
        """A node that begins at column c of the current line."""
        self.deep += 1
        if l[c] == "-" and l[c + 1 : c + 2] in ("", " ", "\t"):
            self.sequence(c, path)
        elif l[c] == "?" and l[c + 1 : c + 2] in ("", " ", "\t") or self.key_end(l, c) >= 0:
            self.mapping(c, path)
        else:
            self.value(c, path, parent)
        self.deep -= 1

    def sequence(self, c: int, path: tuple[str, ...]):
        count = 0
        first = True
        deep = self.deep
        while True:
            if first:
                l = self.line(self.n)
            else:
                found = self.content()
                if not found or found[0] < c:
                    return
                if found[0] > c:
                    raise Bad(self.starts[self.n] + found[0], "unexpected indentation in a sequence")
                l = found[1]
                if not (l[c] == "-" and l[c + 1 : c + 2] in ("", " ", "\t")):
                    return
            first = False
            try:
                self.inline(l, c + 1, (*path, str(count)), c, True)
            except Bad as e:
                self.deep = deep
                self.recover(e, c)
            count += 1

    def recover(self, e: Bad, c: int):
        self.errors.append((e.at, e.why))
        self.n = max(self.n, bisect_right(self.starts, e.at) - 1) + 1

    def inline(self, l: str, i: int, path: tuple[str, ...], parent: int, compact: bool, same: bool = False):
        """What follows '-' , '?' or ':' on a line; same: a sequence may be indented like its key."""
        j = i
        while l[j : j + 1] in (" ", "\t"):
            j += 1
        if j >= len(l) or l[j] == "#" and j > i:
            self.n += 1
            found = self.content()
            if not found:
                return
            if found[0] > parent:
                self.node_at(found[0], found[1], path, parent)
            elif same and found[0] == parent and found[1][parent] == "-" and found[1][parent + 1 : parent + 2] in ("", " ", "\t"):
                self.sequence(parent, path)
            return
        if compact and "\t" not in l[i:j] and (l[j] == "-" and l[j + 1 : j + 2] in ("", " ", "\t") or l[j] == "?" and l[j + 1 : j + 2] in ("", " ") or self.key_end(l, j) >= 0):
            self.node_at(j, l, path, parent)
            return
        m = None
        k = j
        while m := _Y_PROPERTY.match(l, k):
            k = m.end()
        if k > j and (k >= len(l) or l[k] == "#"):
            self.inline(l, len(l), path, parent, False, same)
            return
        self.value(j, path, parent)

    def mapping(self, c: int, path: tuple[str, ...]):
        first = True
        deep = self.deep
        while True:
            if first:
                l = self.line(self.n)
            else:
                found = self.content()
                if not found or found[0] < c:
                    return
                l = found[1]
                if found[0] > c:
                    at = self.starts[self.n] + found[0]
                    self.recover(Bad(at, "unexpected indentation in a mapping"), c)
                    continue
            try:
                if l[c] == "?" and l[c + 1 : c + 2] in ("", " ", "\t"):
                    self.inline(l, c + 1, path, c, True)
                    found = self.content()
                    if found and found[0] == c and found[1][c] == ":" and found[1][c + 1 : c + 2] in ("", " ", "\t"):
                        self.inline(found[1], c + 1, path, c, True)
                    first = False
                    continue
                end = self.key_end(l, c)
                if end < 0:
                    if not first and l[c] == "-" and l[c + 1 : c + 2] in ("", " "):
                        raise Bad(self.starts[self.n] + c, "a sequence entry in a mapping")
                    raise Bad(self.starts[self.n] + c, "could not find expected ':'")
                first = False
                key = l[c:end].strip().strip("\"'")
                self.inline(l, end + 1, (*path, key), c, False, True)
            except Bad as e:
                first = False
                self.deep = deep
                self.recover(e, c)

    def value(self, c: int, path: tuple[str, ...], parent: int):
        """A scalar, alias or flow collection that begins at column c of the current line."""
        l = self.line(self.n)
        while m := _Y_PROPERTY.match(l, c):
            c = m.end()
        at = self.starts[self.n] + c
        s = l[c : c + 1]
        if not s:
            self.n += 1
            return
        if s in "|>":
            if not _Y_HEADER.match(l[c:]):
                raise Bad(at, "invalid header of a block scalar")
            self.n += 1
            start = None
            first = -1
            end = self.starts[self.n] if self.n < len(self.starts) else len(self.t)
            while self.n < len(self.starts):
                x = self.line(self.n)
                if x.strip(" "):
                    i = len(x) - len(x.lstrip(" "))
                    if i <= parent:
                        break
                    if first < 0:
                        first = i
                        start = self.starts[self.n] + i
                    elif i < first:
                        break
                    end = self.starts[self.n] + len(x)
                self.n += 1
            if start is not None:
                self.leaves.append((path, start, end))
            return
        if s in "[{":
            end = self.flow(at, path, parent)
        elif s in "\"'":
            m = (_Y_DOUBLE if s == '"' else _Y_SINGLE).match(self.t, at)
            if not m:
                raise Bad(at, "a quoted scalar was never closed or holds an unknown escape")
            self.leaves.append((path, at + 1, m.end() - 1))
            end = m.end()
        elif s == "*":
            m = _Y_ALIAS.match(self.t, at)
            if not m:
                raise Bad(at, "invalid alias")
            end = m.end()
        else:
            m = _Y_PLAIN.match(l, c)
            if not m:
                raise Bad(at, f"{s!r} cannot begin a scalar")
            end = self.starts[self.n] + m.end()
            rest = l[m.end() :].strip(" \t")
            if rest and rest[0] == ":":
                raise Bad(self.starts[self.n] + m.end(), "mapping values are not allowed here")
            self.n += 1
            start = at
            while not rest and self.n < len(self.starts):  # further lines of the scalar
                x = self.line(self.n)
                y = x.strip(" \t")
                if not y:
                    self.n += 1
                    continue
                i = len(x) - len(x.lstrip(" "))
                if i <= parent or y[0] == "#" or x[:3] in ("---", "...") and not x[3:4].strip():
                    break
                m = re.compile(r"(?:[^\s:#]|:(?=\S)|(?<=\S)#|[ \t]+(?![#\s]))+").match(x, len(x) - len(x.lstrip(" \t")))
                rest = x[m.end() :].strip(" \t") if m else "?"
                if rest and rest[0] != "#":
                    raise Bad(self.starts[self.n] + i, "mapping values are not allowed here")
                end = self.starts[self.n] + m.end()
                self.n += 1
            self.leaves.append((path, start, end))
            return
        self.n = self.t.count("\n", 0, end)
        rest = self.t[end : self.t.find("\n", end) if "\n" in self.t[end:] else len(self.t)].rstrip("\r")
        r = rest.strip(" \t")
        if r and not (r[0] == "#" and rest[0] in " \t"):
            raise Bad(end, "unexpected text after a node")
        self.n += 1

    def flow(self, i: int, path: tuple[str, ...], parent: int) -> int:
        t = self.t
        close = "]" if t[i] == "[" else "}"
        opened = i
        i += 1
        n = 0
        self.deep += 1

        def ws(i: int) -> int:
            while i < len(t):
                c = t[i]
                if c == "\n":
                    j = i + 1
                    while t[j : j + 1] == " ":
                        j += 1
                    if t[j : j + 1] not in ("\n", "\r", "#", "") and j - i - 1 <= parent and t[j : j + 1] not in "]}":
                        raise Bad(j, "a flow collection was not closed")
                    if t[i + 1 : i + 4] in ("---", "..."):
                        raise Bad(i + 1, "a flow collection was not closed")
                    i = j
                elif c in " \t\r":
                    i += 1
                elif c == "#" and t[i - 1] in " \t\n":
                    i = t.find("\n", i)
                    i = len(t) if i < 0 else i
                else:
                    break
            return i

        def node(i: int, p: tuple[str, ...]) -> int:
            while m := _Y_PROPERTY.match(t, i):
                i = ws(m.end())
            c = t[i : i + 1]
            if c and c in "[{":
                return self.flow(i, p, parent)
            if c and c in ",]}:":
                return i
            m = (_Y_DOUBLE if c == '"' else _Y_SINGLE if c == "'" else _Y_ALIAS if c == "*" else _Y_FLOW_PLAIN).match(t, i)
            if not m:
                raise Bad(i, "unexpected character in a flow collection")
            q = c in "\"'"
            self.leaves.append((p, m.start() + q, m.end() - q))
            return m.end()

        while True:
            i = ws(i)
            c = t[i : i + 1]
            if not c:
                raise Bad(opened, "a flow collection was never closed")
            if c == close:
                self.deep -= 1
                return i + 1
            if c == ",":
                raise Bad(i, "unexpected ',' in a flow collection")
            if c == "?" and t[i + 1 : i + 2] in (" ", "\n"):
                i = ws(i + 1)
            start = i
            i = ws(node(i, (*path, str(n))))
            while t[i : i + 1] not in (",", ":", close, ""):  # a plain scalar goes on over a line end
                m = _Y_FLOW_PLAIN.match(t, i)
                if not m or t[start] in "\"'[{" or "\n" not in t[start:i]:
                    raise Bad(i, f"expected ',' or '{close}'")
                i = ws(m.end())
            if t[i : i + 1] == ":":
                key = t[start:i].strip().strip("\"'")
                if self.leaves and self.leaves[-1][1] in (start, start + 1):
                    self.leaves.pop()
                i = ws(i + 1)
                i = ws(node(i, (*path, key)))
            c = t[i : i + 1]
            if c == ",":
                i += 1
            elif c != close:
                raise Bad(i if c else opened, f"expected ',' or '{close}'")
            n += 1

    def stream(self):
        while True:
            # what may stand before a document
            while self.n < len(self.starts):
                l = self.line(self.n)
                if l.strip(" \t") == "" or l.lstrip(" \t")[0] == "#" or l[0] == "%":
                    self.n += 1
                    continue
                break
            if self.n >= len(self.starts):
                return
            l = self.line(self.n)
            if l[:3] in ("---", "...") and not l[3:4].strip():
                rest = l[3:].strip()
                if l[:3] == "---" and rest and rest[0] != "#":
                    c = len(l) - len(l[3:].lstrip(" \t"))
                    try:
                        if self.key_end(l, c) >= 0:
                            raise Bad(self.starts[self.n] + c, "a mapping may not begin here")
                        self.value(c, (), -1)
                    except Bad as e:
                        self.deep = 0
                        self.recover(e, 0)
                else:
                    self.n += 1
                if l[:3] == "...":
                    continue
            try:
                self.block(0, ())
                if self.content() is not None:
                    raise Bad(self.starts[self.n], "expected the start of a document")
            except Bad as e:
                self.deep = 0
                self.recover(e, 0)
            if self.n >= len(self.starts):
                return


def _yaml(text: str) -> tuple[list[tuple[int, str]], list[Leaf]]:
    p = Yaml(text)
    m = re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", p.t)
    if m:
        p.errors.append((m.start(), "a control character"))
    p.stream()
    return p.errors, p.leaves


def json_parse(text: str) -> tuple[list[tuple[int, str]], list[Leaf]]:
    return deeply(lambda: _json(text), ([], []))


def toml_parse(text: str) -> tuple[list[tuple[int, str]], list[Leaf]]:
    return deeply(lambda: _toml(text), ([], []))


def yaml_parse(text: str) -> tuple[list[tuple[int, str]], list[Leaf]]:
    return deeply(lambda: _yaml(text), ([], []))


PARSERS = {"json": json_parse, "toml": toml_parse, "yaml": yaml_parse}


def check(text: str, language: str) -> list[tuple[int, str]]:
    """All syntax errors as (line, what); an empty list for a valid file."""
    errors, _ = PARSERS[language](text)
    ends = [m.start() for m in re.finditer("\n", text)] if errors else []
    return sorted((bisect_left(ends, at) + 1, why) for at, why in errors)
