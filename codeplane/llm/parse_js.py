"""Syntax of JavaScript (module or script): recursive descent, precedence climbing, panic-mode recovery."""

from __future__ import annotations

import re
from functools import lru_cache

from .depth import deeply
from .lexing import JS_WORDS as W
from .lexing import Lexed, lex
from .parse_braces import Bad, Cursor, positions, strip

# Binding power of JavaScript's binary operators.
POWER = {"q": 1, "o": 1, "&": 2, "p": 3, "x": 4, "a": 5, "E": 6, "<": 7, W["instanceof"]: 7, W["in"]: 7, "S": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "P": 11}
SOFT = {W[w] for w in ("let", "static", "async", "of", "get", "set", "await", "yield")}
NAMES = {"n"} | SOFT
WORDS = set(W.values())
UNARY = {"!", "~", "+", "-", W["typeof"], W["void"], W["delete"]}
ATOMS = {"0", "s", "t", "r", W["this"], W["null"], W["true"], W["false"]}
NOT, NAME, PART, DISPLAY = range(4)


class Parser(Cursor):
    known: set[str] = set()

    def __init__(self, s: str):
        super().__init__(s)
        self.functions = self.loops = self.switches = self.labels = self.methods = self.derived = 0
        #: Jumps and uses of 'super' so far: statements that hold one are right in some places only.
        self.bound = 0

    def state(self):
        return self.deep, self.functions, self.loops, self.switches, self.labels, self.methods, self.derived

    def restore(self, state):
        self.deep, self.functions, self.loops, self.switches, self.labels, self.methods, self.derived = state

    def name(self):
        if self.k not in NAMES:
            self.bad("expected a name")
        self.adv()

    def word(self, w: str) -> bool:
        return self.got(W[w])

    def semi(self):
        if self.k == ";":
            self.adv()
        elif not (self.nl or self.k in "}\0"):
            self.bad("expected ';'")

    # ------------------------------------------------------------ expressions
    def expression(self, no_in: bool = False) -> int:
        out = self.assignment(no_in)
        while self.got(","):
            self.assignment(no_in)
            out = NOT
        return out

    def is_arrow(self) -> bool:
        """At '(' or a name: do the parameters of an arrow function begin here?"""
        if self.k == "(":
            end = self.closing(self.i)
            if end < 0:
                return False
            return self.s[end + 1] == "A"
        return self.k in NAMES and self.peek() == "A"

    def arrow(self, no_in: bool):
        if self.k == "(":
            self.parameters()
        else:
            self.name()
        self.take("A")
        if self.k == "{":
            self.body()
        else:
            self.functions += 1
            self.assignment(no_in)
            self.functions -= 1

    def assignment(self, no_in: bool = False) -> int:
        k = self.k
        if k == W["yield"] and self.peek() not in ("=", "G", ".", ";A"):
            self.adv()
            if self.nl or self.k in ");]},:\0":
                return NOT
            self.got("*")
            self.assignment(no_in)
            return NOT
        if k == W["async"] and self.s[self.i + 1] != "\n":
            n = self.s[self.i + 1]
            if n == "(" and (end := self.closing(self.i + 1)) > 0 and self.s[end + 1] == "A" or n in NAMES and self.s[self.i + 2] == "A":
                self.adv()
                self.arrow(no_in)
                return NOT
        if (k == "(" or k in NAMES) and self.is_arrow():
            self.arrow(no_in)
            return NOT
        self.enter()
        out = self.binary(0, no_in)
        if self.k == "?":
            self.adv()
            self.assignment()
            self.take(":")
            self.assignment(no_in)
            out = NOT
        elif self.k == "=":
            if out == NOT:
                self.bad("invalid assignment target")
            self.adv()
            self.assignment(no_in)
            out = NOT
        elif self.k == "G":
            if out not in (NAME, PART):
                self.bad("invalid assignment target")
            self.adv()
            self.assignment(no_in)
            out = NOT
        self.deep -= 1
        return out

    def binary(self, least: int, no_in: bool) -> int:
        out = self.unary()
        while True:
            k = self.k
            p = POWER.get(k)
            if p is None or p < least or no_in and k == W["in"]:
                return out
            self.adv()
            self.binary(p if k == "P" else p + 1, no_in)
            out = NOT

    def unary(self) -> int:
        k = self.k
        if k in UNARY:
            self.adv()
            self.enter()
            self.unary()
            self.deep -= 1
            if self.k == "P":
                self.bad("unary operator before '**'")
            return NOT
        if k == "I":
            self.adv()
            if self.unary() not in (NAME, PART):
                self.bad("invalid operand of '++' or '--'")
            return NOT
        if k == W["await"] and self.peek() not in (";", ")", ",", ".", "=", "G", "]", "}", "A", ":", "\0", "?"):
            self.adv()
            self.unary()
            return NOT
        out = self.postfix()
        if self.k == "I" and not self.nl:
            if out not in (NAME, PART):
                self.bad("invalid operand of '++' or '--'")
            self.adv()
            return NOT
        return out

    def postfix(self) -> int:
        k = self.k
        if k == W["new"]:
            self.adv()
            if self.got("."):
                self.adv()
            else:
                self.enter()
                self.member_only()
                self.deep -= 1
                if self.k == "(":
                    self.arguments()
            out = NOT
        else:
            out = self.primary()
        while True:
            k = self.k
            if k == ".":
                self.adv()
                if self.k != "n" and self.k not in WORDS:
                    self.bad("expected a property name")
                self.adv()
                out = PART
            elif k == "(":
                self.arguments()
                out = NOT
            elif k == "[":
                self.adv()
                self.expression()
                self.take("]")
                out = PART
            elif k == "Q":
                self.adv()
                if self.k == "(":
                    self.arguments()
                elif self.k == "[":
                    self.adv()
                    self.expression()
                    self.take("]")
                elif self.k == "n" or self.k in WORDS:
                    self.adv()
                else:
                    self.bad()
                out = NOT
            elif k == "t":
                self.adv()
                out = NOT
            else:
                return out

    def member_only(self):
        if self.got(W["new"]):
            self.member_only()
            if self.k == "(":
                self.arguments()
        else:
            self.primary()
        while self.k in ".[":
            if self.got("."):
                if self.k != "n" and self.k not in WORDS:
                    self.bad("expected a property name")
                self.adv()
            else:
                self.adv()
                self.expression()
                self.take("]")

    def arguments(self):
        self.take("(")
        while self.k != ")":
            self.got("D")
            self.assignment()
            if not self.got(","):
                break
        self.take(")")

    def primary(self) -> int:
        k = self.k
        if k == W["async"] and self.s[self.i + 1] == W["function"]:
            self.adv()
            k = self.k
        if k in NAMES:
            self.adv()
            return NAME
        if k in ATOMS:
            self.adv()
            return NOT
        if k == "(":
            self.adv()
            self.enter()
            out = self.expression()
            self.deep -= 1
            self.take(")")
            return out if out != DISPLAY else NOT
        if k == "[":
            self.adv()
            self.enter()
            while self.k != "]":
                if self.got(","):
                    continue
                self.got("D")
                self.assignment()
                if self.k != "]":
                    self.take(",")
            self.deep -= 1
            self.adv()
            return DISPLAY
        if k == "{":
            self.object()
            return DISPLAY
        if k == W["function"]:
            self.function(False)
            return NOT
        if k == W["class"]:
            self.class_(False)
            return NOT
        if k == W["super"]:
            self.bound += 1
            if not self.methods or self.peek() not in ".([" or self.peek() == "(" and not self.derived:
                self.bad("unexpected 'super'")
            self.adv()
            return NOT
        if k == W["import"] and self.peek() in "(.":
            self.adv()
            if self.got("."):
                self.adv()
            return NOT
        self.bad("unexpected token")

    def key(self):
        k = self.k
        if k == "[":
            self.adv()
            self.assignment()
            self.take("]")
        elif k in "n0s" or k in WORDS:
            self.adv()
        else:
            self.bad("expected a property name")

    def object(self):
        self.take("{")
        self.enter()
        while self.k != "}":
            if self.got("D"):
                self.assignment()
            else:
                self.property()
            if not self.got(","):
                break
        self.deep -= 1
        self.take("}")

    def property(self):
        k = self.k
        n = self.peek()
        if k == "*":
            self.adv()
            self.key()
            self.method()
            return
        if k in (W["get"], W["set"], W["async"]) and n not in ",:(}=":
            self.adv()
            self.got("*")
            self.key()
            self.method()
            return
        self.key()
        if self.k == "(":
            self.method()
        elif self.got(":"):
            self.assignment()
        elif k in NAMES:
            if self.got("="):
                self.assignment()
        else:
            self.bad("expected ':'")

    # -------------------------------------------------------------- functions
    def parameters(self):
        self.take("(")
        while self.k != ")":
            rest = self.got("D")
            self.binding()
            if self.got("="):
                self.assignment()
            if rest and self.k != ")":
                self.bad("a rest parameter must be last")
            if not self.got(","):
                break
        self.take(")")

    def binding(self):
        if self.k == "[":
            self.adv()
            while self.k != "]":
                if self.got(","):
                    continue
                self.got("D")
                self.binding()
                if self.got("="):
                    self.assignment()
                if self.k != "]":
                    self.take(",")
            self.adv()
        elif self.k == "{":
            self.adv()
            while self.k != "}":
                if self.got("D"):
                    self.binding()
                else:
                    k = self.k
                    self.key()
                    if self.got(":"):
                        self.binding()
                    elif k not in NAMES:
                        self.bad("expected ':'")
                    if self.got("="):
                        self.assignment()
                if not self.got(","):
                    break
            self.take("}")
        else:
            self.name()

    def method(self):
        self.methods += 1
        self.parameters()
        self.body()
        self.methods -= 1

    def body(self):
        around = self.loops, self.switches, self.labels
        self.loops = self.switches = self.labels = 0
        self.functions += 1
        self.enter()
        self.take("{")
        self.list_of(self.statement, "}")
        self.functions -= 1
        self.deep -= 1
        self.loops, self.switches, self.labels = around
        self.take("}")

    def function(self, named: bool):
        self.take(W["function"])
        self.got("*")
        if self.k in NAMES:
            self.adv()
        elif named:
            self.bad("expected a function name")
        around = self.methods, self.derived
        self.methods = self.derived = 0
        self.parameters()
        self.body()
        self.methods, self.derived = around

    def class_(self, named: bool):
        self.take(W["class"])
        if self.k in NAMES:
            self.adv()
        elif named:
            self.bad("expected a class name")
        derived = self.word("extends")
        if derived:
            self.postfix()
        around = self.derived
        self.derived = int(derived)
        self.take("{")
        self.enter()
        self.list_of(self.class_member, "}")
        self.deep -= 1
        self.derived = around
        self.take("}")

    def class_member(self):
        if self.got(";"):
            return
        if self.k == W["static"] and self.peek() not in "(=;}":
            self.adv()
            if self.k == "{":
                around = self.loops, self.switches, self.labels
                self.loops = self.switches = self.labels = 0
                self.methods += 1
                self.block()
                self.methods -= 1
                self.loops, self.switches, self.labels = around
                return
        if self.k in (W["get"], W["set"], W["async"]) and self.peek() not in "(=;}":
            self.adv()
        self.got("*")
        self.key()
        if self.k == "(":
            self.method()
        else:
            if self.got("="):
                self.functions += 1
                self.methods += 1
                self.assignment()
                self.methods -= 1
                self.functions -= 1
            self.semi()

    # ------------------------------------------------------------- statements
    def block(self):
        self.take("{")
        self.enter()
        self.list_of(self.statement, "}")
        self.deep -= 1
        self.take("}")

    def statement(self):
        if (self.functions or self.k != W["return"]) and self.statement_known():
            return
        start, bound = self.i, self.bound
        self.enter()
        self.statement_()
        self.deep -= 1
        if self.functions and self.bound == bound:
            self.remember(start)

    def statement_(self):
        k = self.k
        handler = _STATEMENTS.get(k)
        if handler:
            handler(self)
            return
        if k == W["async"] and self.s[self.i + 1] == W["function"]:
            self.adv()
            self.function(True)
            return
        if k == W["import"] and self.peek() not in "(.":
            self.import_()
            return
        if k == W["let"] and (self.peek() in NAMES or self.peek() in "[{"):
            self.declaration()
            self.semi()
            return
        if k in NAMES and self.peek() == ":":
            self.adv()
            self.adv()
            self.labels += 1
            self.statement()
            self.labels -= 1
            return
        self.expression()
        self.semi()

    def declaration(self, header: bool = False):
        constant = self.k == W["const"]
        self.adv()
        while True:
            pattern = self.k in "[{"
            self.binding()
            if self.got("="):
                self.assignment(header)
            elif not header and (pattern or constant):
                self.bad("a declaration without a value")
            if not self.got(","):
                break

    def declared(self):
        self.declaration()
        self.semi()

    def if_(self):
        self.adv()
        self.condition()
        self.statement()
        if self.word("else"):
            self.statement()

    def condition(self):
        self.take("(")
        self.expression()
        self.take(")")

    def for_(self):
        self.adv()
        self.word("await")
        self.take("(")
        k = self.k
        if k in (W["var"], W["const"]) or k == W["let"] and (self.peek() in NAMES or self.peek() in "[{"):
            at = self.i
            self.declaration(True)
            if self.s[at] == W["const"] and self.k == ";" and "=" not in self.s[at : self.i]:
                self.bad("a declaration without a value")
        elif k != ";":
            out = self.expression(True)
            if self.k in (W["of"], W["in"]) and out == NOT:
                self.bad("invalid target of a loop")
        if self.k in (W["of"], W["in"]):
            of = self.k == W["of"]
            self.adv()
            self.assignment() if of else self.expression()
        else:
            self.take(";")
            if self.k != ";":
                self.expression()
            self.take(";")
            if self.k != ")":
                self.expression()
        self.take(")")
        self.looped()

    def looped(self):
        self.loops += 1
        self.statement()
        self.loops -= 1

    def while_(self):
        self.adv()
        self.condition()
        self.looped()

    def with_(self):
        self.adv()
        self.condition()
        self.statement()

    def do_(self):
        self.adv()
        self.looped()
        self.take(W["while"])
        self.condition()
        self.got(";")

    def return_(self):
        if not self.functions:
            self.bad("'return' outside a function")
        self.adv()
        if self.nl or self.k in ";}\0":
            self.semi()
            return
        self.expression()
        self.semi()

    def jump_(self):
        k = self.k
        self.bound += 1
        labelled = self.peek() in NAMES and self.s[self.i + 1] != "\n"
        if not (self.labels if labelled else self.loops or k == W["break"] and self.switches):
            self.bad("a jump that nothing encloses")
        self.adv()
        if labelled:
            self.adv()
        self.semi()

    def debugger_(self):
        self.adv()
        self.semi()

    def throw_(self):
        self.adv()
        if self.nl:
            self.bad("line end after 'throw'")
        self.expression()
        self.semi()

    def try_(self):
        self.adv()
        self.block()
        if self.word("catch"):
            if self.got("("):
                self.binding()
                self.take(")")
            self.block()
            if self.word("finally"):
                self.block()
        elif self.word("finally"):
            self.block()
        else:
            self.bad("'try' without 'catch' or 'finally'")

    def switch_(self):
        self.adv()
        self.condition()
        self.take("{")
        self.enter()
        self.switches += 1
        while self.k != "}":
            if self.word("case"):
                self.expression()
            else:
                self.take(W["default"])
            self.take(":")
            while self.k not in (W["case"], W["default"], "}", "\0"):
                self.statement()
            if self.k == "\0":
                break
        self.switches -= 1
        self.deep -= 1
        self.take("}")

    def import_(self):
        self.adv()
        if self.k == "s":
            self.adv()
        else:
            if self.k in NAMES:
                self.adv()
                if not self.got(","):
                    self.from_()
                    return
            if self.got("*"):
                self.name()  # 'as'
                self.name()
            else:
                self.specifiers()
            self.from_()
            return
        self.attributes()
        self.semi()

    def from_(self):
        self.name()
        self.take("s")
        self.attributes()
        self.semi()

    def attributes(self):
        if self.k == W["with"] and self.peek() == "{":
            self.adv()
            self.object()

    def specifiers(self):
        self.take("{")
        while self.k != "}":
            if self.k not in "ns" and self.k not in WORDS:
                self.bad()
            self.adv()
            if self.k == "n":
                self.adv()
                if self.k not in "ns" and self.k not in WORDS:
                    self.bad()
                self.adv()
            if not self.got(","):
                break
        self.take("}")

    def export_(self):
        self.adv()
        k = self.k
        if self.word("default"):
            if self.k == W["function"]:
                self.function(False)
            elif self.k == W["async"] and self.s[self.i + 1] == W["function"]:
                self.adv()
                self.function(False)
            elif self.k == W["class"]:
                self.class_(False)
            else:
                self.assignment()
                self.semi()
        elif k == "{":
            self.specifiers()
            if self.k == "n":
                self.from_()
            else:
                self.semi()
        elif self.got("*"):
            if self.k == "n" and self.peek() != "s":
                self.adv()
                self.adv()
            self.from_()
        elif k in (W["var"], W["let"], W["const"], W["function"], W["class"], W["async"]):
            self.statement_()
        else:
            self.bad("unexpected token after 'export'")

    def program(self):
        while self.k != "\0":
            self.list_of(self.statement, "}")
            if self.k == "}":
                self.errors.append((self.i, "unmatched '}'"))
                self.adv()


_STATEMENTS = {
    "{": Parser.block,
    ";": Parser.adv,
    W["var"]: Parser.declared,
    W["const"]: Parser.declared,
    W["if"]: Parser.if_,
    W["for"]: Parser.for_,
    W["while"]: Parser.while_,
    W["do"]: Parser.do_,
    W["return"]: Parser.return_,
    W["break"]: Parser.jump_,
    W["continue"]: Parser.jump_,
    W["debugger"]: Parser.debugger_,
    W["throw"]: Parser.throw_,
    W["try"]: Parser.try_,
    W["switch"]: Parser.switch_,
    W["with"]: Parser.with_,
    W["function"]: lambda p: p.function(True),
    W["class"]: lambda p: p.class_(True),
    W["export"]: Parser.export_,
}

_HOLE = re.compile(r"\$\{")


@lru_cache(maxsize=100_000)
def _hole(kinds: str) -> str:
    p = Parser(kinds)
    p.functions = p.methods = p.derived = 1  # what encloses the template was parsed apart from it
    try:
        p.expression()
        return "" if p.k == "\0" else "unexpected token in a template"
    except Bad as e:
        return e.why


def _template(token: str) -> str:
    i = 0
    while (i := token.find("${", i)) >= 0:
        level, j = 1, i + 2
        while j < len(token) and level:
            c = token[j]
            level += c == "{"
            level -= c == "}"
            j += 1
        if token[i - 1 : i] != "\\" and (why := deeply(lambda: _hole(strip(lex(token[i + 2 : j - 1], "js").kinds)), "")):
            return why
        i = j
    return ""


def check(text: str, lexed: Lexed | None = None) -> list[tuple[int, str]]:
    """All syntax errors as (line, what); an empty list for a valid file."""
    if text[:2] == "#!":
        text, lexed = "//" + text[2:], None
    x = lexed or lex(text, "js")

    def parse() -> list[tuple[int, str]]:
        p = Parser(strip(x.kinds))
        try:
            p.program()
        except Bad as e:
            p.errors.append((e.at, e.why))
        return p.errors

    out = positions(x, text, deeply(parse, []))
    if "t" in x.kinds:
        for n, t in enumerate(x.tokens):
            if x.kinds[n] == "t" and "${" in t and (why := _template(t)):
                out.append((text.count("\n", 0, x.start(n)) + 1, why))
        out.sort()
    return out
