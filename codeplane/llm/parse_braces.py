"""What the parsers of brace languages share: the cursor, statement memory and panic-mode recovery."""

from __future__ import annotations

import re
from bisect import bisect_left

from .lexing import Lexed

_BRACKET = re.compile(r"[()\[\]{}]")
_OPEN = {"(": ")", "[": "]", "{": "}"}
REMEMBERED = 300_000


class Bad(Exception):
    def __init__(self, at: int, why: str):
        self.at, self.why = at, why


class Cursor:
    """Reads a string of kinds; line ends are skipped, but ``nl`` tells whether one came before the current kind."""

    #: Statements, from their first kind to their ';', that were parsed before.
    known: set[str]

    def __init__(self, s: str):
        self.s = s + "\0\0\0\0"
        self.i = 0
        self.nl = False
        self.deep = 0
        self.errors: list[tuple[int, str]] = []
        self._match: dict[int, int] | None = None
        if self.s[0] == "\n":
            self.i, self.nl = 1, True

    @property
    def k(self) -> str:
        return self.s[self.i]

    def adv(self):
        i = self.i + 1
        if self.s[i] == "\n":
            i += 1
            self.nl = True
        else:
            self.nl = False
        self.i = i

    def peek(self, n: int = 1) -> str:
        """The n-th kind after the current one."""
        i = self.i
        while n:
            i += 1
            if self.s[i] == "\n":
                i += 1
            n -= 1
        return self.s[i]

    def jump(self, i: int):
        self.i = i
        self.nl = False
        if self.s[i] == "\n":
            self.i, self.nl = i + 1, True

    def bad(self, why: str = "unexpected token"):
        raise Bad(self.i, why)

    def take(self, kind: str):
        if self.s[self.i] != kind:
            self.bad(f"expected '{kind}'" if kind.isascii() else "expected a keyword")
        self.adv()

    def got(self, kind: str) -> bool:
        if self.s[self.i] == kind:
            self.adv()
            return True
        return False

    def closing(self, at: int) -> int:
        """Position of the bracket that closes the one at position at; -1 if none."""
        if self._match is None:
            self._match, stack = {}, []
            for m in _BRACKET.finditer(self.s):
                c = m[0]
                if c in _OPEN:
                    stack.append((c, m.start()))
                elif stack and _OPEN[stack[-1][0]] == c:
                    self._match[stack.pop()[1]] = m.start()
        return self._match.get(at, -1)

    def list_of(self, each, end: str):
        """Calls each until end or the end of the text; after an error, resumes at the next statement."""
        state = self.state()
        while True:
            k = self.s[self.i]
            if k == end or k == "\0":
                return
            at = self.i
            try:
                each()
            except Bad as e:
                self.errors.append((e.at, e.why))
                self.restore(state)
                self.panic(max(at, self.i))

    def state(self):
        """What encloses the cursor, to be restored after an error."""
        return self.deep

    def restore(self, state):
        self.deep = state

    def panic(self, at: int):
        level = 0
        s, n = self.s, len(self.s) - 1
        i = max(at, self.i)
        while i < n and s[i] != "\0":
            c = s[i]
            if c in "([{":
                level += 1
            elif c in ")]}":
                if c == "}" and level <= 0:
                    if i == at:
                        i += 1
                    break
                level -= 1
            elif c == ";" and level <= 0:
                i += 1
                break
            i += 1
        self.jump(i)

    def statement_known(self) -> bool:
        s, i = self.s, self.i
        j = s.find(";", i, i + 120)
        if j >= 0 and s[i : j + 1] in self.known:
            self.jump(j + 1)
            return True
        return False

    def remember(self, start: int):
        """After a statement that began at start and whose last kind is the ';' just passed."""
        end = self.i - (self.nl and self.s[self.i - 1] == "\n")
        if 0 < end - start <= 120 and self.s[end - 1] == ";" and len(self.known) < REMEMBERED:
            seg = self.s[start:end]
            if seg.find(";") == len(seg) - 1:
                self.known.add(seg)

    def enter(self):
        self.deep += 1


def strip(kinds: str) -> str:
    """Kinds without comments and with single line ends."""
    s = kinds.replace("#", "").replace("N", "\n")
    while "\n\n" in s:
        s = s.replace("\n\n", "\n")
    return s


def positions(lexed: Lexed, text: str, errors: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Errors at positions of the stripped kinds -> errors at lines of the text."""
    if not errors:
        return []
    kept, kinds, before = [], lexed.kinds.replace("N", "\n"), ""
    for n, k in enumerate(kinds):
        if k == "#" or k == "\n" and before == "\n":
            continue
        before = k
        kept.append(n)
    out = []
    ends = [m.start() for m in re.finditer("\n", text)]
    for at, why in errors:
        if at >= len(kept):
            out.append((len(ends) + 1, "unexpected end of file" if why.startswith(("unexpected", "expected")) else why))
        else:
            out.append((bisect_left(ends, lexed.start(kept[at])) + 1, why))
    return sorted(out)
