"""Packrat parsing-expression grammars over strings of token kinds.

A grammar is written as text, one rule a line::

    rule <- item item / item item      # ordered choice
    item: 'k' one kind, [set] or [^set] a class, ~regex~ a regular expression, name another rule,
          each with ? * + after it, & or ! before it, (...) groups, name:item captures, <pred> a predicate.

Words in braces inside quotes, classes and expressions, as ``{def}``, stand for the kinds of reserved
words.  Every rule is memoised by position, so each position is parsed at most once by each rule.
"""

from __future__ import annotations

import re
from collections.abc import Callable


Match = tuple[int, tuple]
FAIL: Match = (-1, ())


class Grammar:
    def __init__(self, text: str, words: dict[str, str], predicates: dict[str, Callable] | None = None):
        self.predicates = predicates or {}
        self.rules: dict[str, Callable] = {}
        fill = lambda s: re.sub(r"\{(\w+)\}", lambda m: words[m[1]] if m[1] in words else m[0], s)
        for line in text.strip().splitlines():
            line = line.split("   #")[0].strip()
            if line:
                name, body = line.split("<-", 1)
                self.rules[name.strip()] = self._rule(name.strip(), body, fill)

    def _rule(self, name: str, body: str, fill) -> Callable:
        tokens = []
        i = 0
        body = body.strip()
        while i < len(body):
            m = re.compile(r"\s*(?:(\w+):(?=\S)|('[^']*')|(\[(?:\\.|[^\]\\])*\])|(~[^~]*~)|<(\w+)>|(\w+)|([/()?*+&!]))\s*").match(body, i)
            if not m:
                raise ValueError(f"{name}: {body[i:]}")
            tokens.append(next((n, x) for n, x in enumerate(m.groups()) if x is not None))
            i = m.end()
        tokens.append((9, ""))
        at = [0]

        def choice():
            options = [sequence()]
            while tokens[at[0]] == (6, "/"):
                at[0] += 1
                options.append(sequence())
            if len(options) == 1:
                return options[0]

            def run(p, pos):
                for f in options:
                    r = f(p, pos)
                    if r[0] >= 0:
                        return r
                return FAIL

            return run

        def sequence():
            items = []
            while tokens[at[0]] not in ((6, "/"), (6, ")"), (9, "")):
                items.append(item())
            if len(items) == 1:
                return items[0]

            def run(p, pos):
                found: tuple = ()
                for f in items:
                    pos, c = f(p, pos)
                    if pos < 0:
                        return FAIL
                    if c:
                        found += c
                return pos, found

            return run

        def item():
            kind, x = tokens[at[0]]
            if kind == 0:
                at[0] += 1
                f = item()

                def capture(p, pos):
                    end, c = f(p, pos)
                    return (end, ((x, pos, end), *c)) if end >= 0 else FAIL

                return capture
            if kind == 6 and x in "&!":
                at[0] += 1
                f = item()
                want = x == "&"
                return lambda p, pos: (pos, ()) if (f(p, pos)[0] >= 0) == want else FAIL
            at[0] += 1
            if kind == 6 and x == "(":
                f = choice()
                at[0] += 1
            elif kind == 1:
                lit = fill(x[1:-1])

                def f(p, pos):
                    return (pos + len(lit), ()) if p.s.startswith(lit, pos) else FAIL
            elif kind in (2, 3):
                rx = re.compile(fill(x if kind == 2 else x[1:-1]), re.S).match

                def f(p, pos):
                    m = rx(p.s, pos)
                    return (m.end(), ()) if m else FAIL
            elif kind == 4:
                test = self.predicates[x]
                f = lambda p, pos: (pos, ()) if test(p, pos) else FAIL
            else:
                f = lambda p, pos: p.apply(x, pos)
            op = tokens[at[0]]
            if op[0] == 6 and op[1] in "?*+":
                at[0] += 1
                f = self._repeat(f, op[1])
            return f

        return choice()

    @staticmethod
    def _repeat(f, op):
        if op == "?":

            def run(p, pos):
                r = f(p, pos)
                return r if r[0] >= 0 else (pos, ())

            return run

        def run(p, pos):
            found: tuple = ()
            n = 0
            while True:
                end, c = f(p, pos)
                if end < 0 or end == pos:
                    break
                pos = end
                n += 1
                if c:
                    found += c
            return (pos, found) if n or op == "*" else FAIL

        return run


class Packrat:
    """One parse of the kinds s."""

    def __init__(self, grammar: Grammar, s: str):
        self.g, self.s, self.memo = grammar.rules, s, {}

    def apply(self, rule: str, pos: int) -> Match:
        key = (rule, pos)
        r = self.memo.get(key)
        if r is None:
            self.memo[key] = FAIL  # left recursion fails
            r = self.memo[key] = self.g[rule](self, pos)
        return r
