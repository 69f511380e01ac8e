"""Syntax of Java: recursive descent, precedence climbing, panic-mode recovery."""

from __future__ import annotations

from .depth import deeply
from .lexing import JAVA_WORDS as W
from .lexing import Lexed, lex
from .parse_braces import Bad, Cursor, positions, strip

# Binding power of Java's binary operators.
POWER = {"o": 1, "&": 2, "p": 3, "x": 4, "a": 5, "E": 6, "<": 7, ">": 7, "C": 7, W["instanceof"]: 7, "S": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
PRIMITIVES = {W[w] for w in ("boolean", "byte", "char", "double", "float", "int", "long", "short")}
MODIFIERS = {W[w] for w in ("abstract", "default", "final", "native", "private", "protected", "public", "static", "strictfp", "synchronized", "transient", "volatile", "sealed")}
NAMES = {"n"} | {W[w] for w in ("record", "var", "yield", "sealed", "permits")}
LITERALS = {"0", "s", W["true"], W["false"], W["null"]}
NOT, PLACE, CALL = range(3)


class Parser(Cursor):
    known: set[str] = set()

    def name(self):
        if self.k not in NAMES:
            self.bad("expected a name")
        self.adv()

    def word(self, w: str) -> bool:
        return self.got(W[w])

    def qualified(self):
        self.name()
        while self.k == "." and self.peek() in NAMES:
            self.adv()
            self.adv()

    # ------------------------------------------------------------------ types
    def annotations(self):
        while self.k == "@" and self.peek() != W["interface"]:
            self.adv()
            self.qualified()
            if self.got("("):
                while self.k != ")":
                    if self.k in NAMES and self.peek() == "=":
                        self.adv()
                        self.adv()
                    self.element()
                    if not self.got(","):
                        break
                self.take(")")

    def element(self):
        if self.k == "{":
            self.adv()
            while self.k != "}":
                self.element()
                if not self.got(","):
                    break
            self.take("}")
        elif self.k == "@":
            self.annotations()
        else:
            self.ternary()

    def type(self, arrays: bool = True):
        self.annotations()
        if self.k in PRIMITIVES:
            self.adv()
        else:
            self.name()
            self.type_arguments()
            while self.k == "." and self.peek() in NAMES:
                self.adv()
                self.adv()
                self.type_arguments()
        while arrays and self.k == "[" and self.peek() == "]":
            self.adv()
            self.adv()

    def type_arguments(self):
        if self.k != "<":
            return
        self.adv()
        self.enter()
        while self.k != ">":
            self.annotations()
            if self.got("?"):
                if self.k in (W["extends"], W["super"]):
                    self.adv()
                    self.type()
            else:
                self.type()
            if not self.got(","):
                break
        self.deep -= 1
        self.take(">")

    def type_parameters(self):
        if self.k != "<":
            return
        self.adv()
        while True:
            self.annotations()
            self.name()
            if self.word("extends"):
                self.type()
                while self.got("a"):
                    self.type()
            if not self.got(","):
                break
        self.take(">")

    def attempt(self, what) -> bool:
        """Whether what parses here; if not, nothing is read."""
        i, nl, deep = self.i, self.nl, self.deep
        try:
            what()
            return True
        except Bad:
            self.i, self.nl, self.deep = i, nl, deep
            return False

    # ------------------------------------------------------------ expressions
    def expression(self) -> int:
        self.enter()
        if self.is_lambda():
            self.lambda_()
            out = NOT
        else:
            out = self.ternary()
            if self.k in "=G" or self.k == ">" and self.s[self.i + 1] in ">C":
                if out != PLACE:
                    self.bad("invalid assignment target")
                while self.k == ">":
                    self.adv()
                self.adv()
                self.expression()
                out = CALL
        self.deep -= 1
        return out

    def is_lambda(self) -> bool:
        if self.k in NAMES:
            return self.peek() == "A"
        if self.k == "(":
            end = self.closing(self.i)
            return end > 0 and self.s[end + 1] == "A"
        return False

    def lambda_(self):
        if self.k == "(":
            self.adv()
            while self.k != ")":
                if not (self.k in NAMES and self.peek() in ",)"):
                    self.modifiers()
                    self.type()
                    self.got("D")
                self.name()
                if not self.got(","):
                    break
            self.take(")")
        else:
            self.name()
        self.take("A")
        if self.k == "{":
            self.block()
        else:
            self.expression()

    def ternary(self) -> int:
        out = self.binary(0)
        if self.got("?"):
            self.lambda_() if self.is_lambda() else self.ternary()
            self.take(":")
            self.lambda_() if self.is_lambda() else self.ternary()
            return NOT
        return out

    def binary(self, least: int) -> int:
        out = self.unary()
        while True:
            k = self.k
            p = POWER.get(k)
            if p is None or p < least:
                return out
            if k == ">" and self.s[self.i + 1] == ">":  # shifts are read as two or three signs
                if 8 < least:
                    return out
                n = 3 if self.s[self.i + 2] == ">" else 2
                if self.s[self.i + n] == "C" or self.s[self.i + n] == "G":
                    return out
                for _ in range(n):
                    self.adv()
                self.binary(9)
            elif k == ">" and self.s[self.i + 1] == "C":
                return out
            elif k == W["instanceof"]:
                self.adv()
                self.word("final")
                self.type()
                if self.k == "(":
                    self.record_pattern()
                if self.k in NAMES:
                    self.adv()
            else:
                self.adv()
                self.binary(p + 1)
            out = NOT

    def record_pattern(self):
        self.take("(")
        while self.k != ")":
            self.type()
            if self.k == "(":
                self.record_pattern()
            if self.k in NAMES:
                self.adv()
            if not self.got(","):
                break
        self.take(")")

    def cast(self):
        self.take("(")
        primitive = self.k in PRIMITIVES
        self.type()
        primitive = primitive and self.s[self.i - 1] in PRIMITIVES
        while self.got("a"):
            self.type()
        self.take(")")
        k = self.k
        if not (k in NAMES or k in LITERALS or k in PRIMITIVES or k in "(!~" or k in (W["this"], W["new"], W["super"], W["switch"]) or primitive and k in "+-I"):
            self.bad()

    def unary(self) -> int:
        k = self.k
        if k in "+-!~":
            self.adv()
            self.enter()
            self.unary()
            self.deep -= 1
            return NOT
        if k == "I":
            self.adv()
            if self.unary() != PLACE:
                self.bad("invalid operand of '++' or '--'")
            return CALL
        if k == "(" and not self.is_lambda() and self.attempt(self.cast):
            self.enter()
            self.lambda_() if self.is_lambda() else self.unary()
            self.deep -= 1
            return NOT
        out = self.postfix()
        while self.k == "I":
            if out != PLACE:
                self.bad("invalid operand of '++' or '--'")
            self.adv()
            out = CALL
        return out

    def arguments(self):
        self.take("(")
        while self.k != ")":
            self.expression()
            if not self.got(","):
                break
        self.take(")")

    def generic_reference(self):
        self.type()
        if self.k != "M":
            self.bad()

    def postfix(self) -> int:
        k = self.k
        s = self.s
        if k in NAMES:
            n = s[self.i + 1]
            if (n == "<" or n == "[" and s[self.i + 2] == "]") and self.attempt(self.generic_reference):
                out = NOT
            else:
                self.adv()
                out = PLACE
                if self.k == "(":
                    self.arguments()
                    out = CALL
        elif k in LITERALS:
            self.adv()
            out = NOT
        elif k == "(":
            self.adv()
            out = self.expression()
            self.take(")")
            out = out if out == PLACE else NOT
        elif k in (W["this"], W["super"]):
            self.adv()
            out = NOT
            if self.k == "(":
                self.arguments()
                out = CALL
        elif k == W["new"]:
            out = self.creation()
        elif k == W["switch"]:
            self.switch()
            out = NOT
        elif k in PRIMITIVES or k == W["void"]:
            self.adv()
            while self.k == "[":
                self.adv()
                self.take("]")
            if self.k == ".":
                self.adv()
                self.take(W["class"])
            elif self.k != "M":
                self.bad()
            out = NOT
        else:
            self.bad()
        while True:
            k = self.k
            if k == ".":
                self.adv()
                if self.k == "<":
                    self.type_arguments()
                if self.k in NAMES:
                    self.adv()
                    out = PLACE
                    if self.k == "(":
                        self.arguments()
                        out = CALL
                elif self.k in (W["class"], W["this"], W["super"]):
                    self.adv()
                    out = NOT
                    if self.k == "(":
                        self.arguments()
                elif self.k == W["new"]:
                    out = self.creation()
                else:
                    self.bad("expected a name")
            elif k == "[":
                if self.peek() == "]":
                    while self.got("["):
                        self.take("]")
                    if self.got("."):
                        self.take(W["class"])
                    elif self.k != "M":
                        self.bad()
                    out = NOT
                else:
                    self.adv()
                    self.expression()
                    self.take("]")
                    out = PLACE
            elif k == "M":
                self.adv()
                self.type_arguments()
                if not self.word("new"):
                    self.name()
                out = NOT
            else:
                return out

    def creation(self) -> int:
        self.take(W["new"])
        self.type_arguments()
        self.annotations()
        if self.k in PRIMITIVES:
            self.adv()
        else:
            self.name()
            self.diamond()
            while self.got("."):
                self.name()
                self.diamond()
        if self.k == "(":
            self.arguments()
            if self.k == "{":
                self.class_body()
            return CALL
        if self.k != "[":
            self.bad("expected '(' or '['")
        empty = False
        while self.k == "[":
            self.adv()
            if self.k == "]":
                empty = True
            elif empty:
                self.bad()
            else:
                self.expression()
            self.take("]")
        if self.k == "{":
            self.array()
        elif empty and self.s[self.i - 2] == "[":
            pass
        return NOT

    def diamond(self):
        if self.k == "<" and self.peek() == ">":
            self.adv()
            self.adv()
        else:
            self.type_arguments()

    def array(self):
        self.take("{")
        self.enter()
        while self.k != "}":
            self.array() if self.k == "{" else self.expression()
            if not self.got(","):
                break
        self.deep -= 1
        self.take("}")

    # ------------------------------------------------------------- statements
    def block(self):
        self.take("{")
        self.enter()
        self.list_of(self.statement, "}")
        self.deep -= 1
        self.take("}")

    def statement(self):
        if self.statement_known():
            return
        start = self.i
        self.enter()
        self.statement_()
        self.deep -= 1
        self.remember(start)

    def semi(self):
        self.take(";")

    def parens(self):
        self.take("(")
        self.expression()
        self.take(")")

    def is_declaration(self) -> bool:
        i, nl, deep = self.i, self.nl, self.deep
        try:
            self.type()
            return self.k in NAMES and self.peek() in "=;,:["
        except Bad:
            return False
        finally:
            self.i, self.nl, self.deep = i, nl, deep

    def declarators(self):
        while True:
            self.name()
            while self.got("["):
                self.take("]")
            if self.got("="):
                self.array() if self.k == "{" else self.expression()
            if not self.got(","):
                return

    def modifiers(self):
        while True:
            if self.k == "@" and self.peek() != W["interface"]:
                self.annotations()
            elif self.k in MODIFIERS and not (self.k == W["default"] and self.peek() in ":A") and not (self.k == W["synchronized"] and self.peek() == "("):
                if self.k == W["sealed"] and self.peek() not in MODIFIERS and self.peek() not in (W["class"], W["interface"]):
                    return
                self.adv()
            elif self.k == "n" and self.s[self.i + 1 : self.i + 3] == "-" + W["sealed"]:
                self.adv()
                self.adv()
                self.adv()
            else:
                return

    def is_type_declaration(self) -> bool:
        k = self.k
        return k in (W["class"], W["interface"], W["enum"]) or k == "@" and self.peek() == W["interface"] or k == W["record"] and self.peek() in NAMES and self.peek(2) in "(<"

    def statement_(self):
        k = self.k
        if k == "{":
            self.block()
        elif k == ";":
            self.adv()
        elif k == W["if"]:
            self.adv()
            self.parens()
            self.statement()
            if self.word("else"):
                self.statement()
        elif k == W["for"]:
            self.adv()
            self.take("(")
            if self.k != ";":
                self.modifiers()
                if self.is_declaration():
                    self.type()
                    if self.peek() == ":":
                        self.name()
                        self.adv()
                        self.expression()
                        self.take(")")
                        self.statement()
                        return
                    self.declarators()
                else:
                    self.expression()
                    while self.got(","):
                        self.expression()
            self.semi()
            if self.k != ";":
                self.expression()
            self.semi()
            if self.k != ")":
                self.expression()
                while self.got(","):
                    self.expression()
            self.take(")")
            self.statement()
        elif k == W["while"]:
            self.adv()
            self.parens()
            self.statement()
        elif k == W["do"]:
            self.adv()
            self.statement()
            self.take(W["while"])
            self.parens()
            self.semi()
        elif k == W["try"]:
            self.adv()
            resources = self.k == "("
            if self.got("("):
                while self.k != ")":
                    self.modifiers()
                    if self.is_declaration():
                        self.type()
                        self.name()
                        self.take("=")
                    self.expression()
                    if not self.got(";"):
                        break
                self.take(")")
            self.block()
            caught = False
            while self.word("catch"):
                caught = True
                self.take("(")
                self.modifiers()
                self.type()
                while self.got("p"):
                    self.type()
                self.name()
                self.take(")")
                self.block()
            if self.word("finally"):
                self.block()
            elif not (caught or resources):
                self.bad("'try' without 'catch' or 'finally'")
        elif k == W["switch"]:
            self.switch()
            if self.k == ".":
                self.bad()
        elif k == W["synchronized"]:
            self.adv()
            self.parens()
            self.block()
        elif k == W["return"]:
            self.adv()
            if self.k != ";":
                self.expression()
            self.semi()
        elif k == W["throw"]:
            self.adv()
            self.expression()
            self.semi()
        elif k in (W["break"], W["continue"]):
            self.adv()
            if self.k in NAMES:
                self.adv()
            self.semi()
        elif k == W["yield"] and self.peek() not in "=.(G[I":
            self.adv()
            self.expression()
            self.semi()
        elif k == W["assert"]:
            self.adv()
            self.expression()
            if self.got(":"):
                self.expression()
            self.semi()
        elif k in NAMES and self.peek() == ":":
            self.adv()
            self.adv()
            self.statement()
        else:
            at = self.i
            self.modifiers()
            if self.is_type_declaration():
                self.type_declaration()
            elif self.is_declaration():
                self.type()
                self.declarators()
                self.semi()
            elif self.i != at:
                self.bad()
            else:
                if self.expression() != CALL:
                    self.i = at
                    self.bad("not a statement")
                self.semi()

    def switch(self):
        self.take(W["switch"])
        self.parens()
        self.take("{")
        self.enter()
        while self.k not in "}\0":
            if self.word("default"):
                pass
            else:
                self.take(W["case"])
                while True:
                    if self.word("default") or self.word("null"):
                        pass
                    else:
                        i = self.i
                        self.modifiers()
                        if not (self.attempt(self.case_pattern)):
                            self.i = i
                            self.ternary()
                    if not self.got(","):
                        break
                if self.k == "n" and self.peek() not in ":A":  # a guard
                    self.adv()
                    self.expression()
            if self.got("A"):
                if self.k in ("{", W["throw"]):
                    self.statement()
                else:
                    self.expression()
                    self.semi()
            else:
                self.take(":")
                while self.k not in (W["case"], W["default"], "}", "\0"):
                    self.statement()
        self.deep -= 1
        self.take("}")

    def case_pattern(self):
        self.type()
        if self.k == "(":
            self.record_pattern()
        else:
            self.name()

    # ----------------------------------------------------------- declarations
    def parameters(self):
        self.take("(")
        while self.k != ")":
            self.modifiers()
            self.type()
            self.annotations()
            self.got("D")
            if self.k == W["this"]:
                self.adv()
            else:
                self.name()
            while self.got("["):
                self.take("]")
            if not self.got(","):
                break
        self.take(")")

    def types(self):
        self.type()
        while self.got(","):
            self.type()

    def type_declaration(self):
        k = self.k
        if k == "@":
            self.adv()
        kind = self.k
        self.adv()
        self.name()
        self.type_parameters()
        if kind == W["record"]:
            self.parameters()
        for w in ("extends", "implements", "permits"):
            if self.word(w):
                self.types()
        if kind == W["enum"]:
            self.enum_body()
        else:
            self.class_body()

    def enum_body(self):
        self.take("{")
        self.enter()
        while self.k in NAMES or self.k == "@":
            self.annotations()
            self.name()
            if self.k == "(":
                self.arguments()
            if self.k == "{":
                self.class_body()
            if not self.got(","):
                break
        if self.got(";"):
            self.list_of(self.member, "}")
        self.deep -= 1
        self.take("}")

    def class_body(self):
        self.take("{")
        self.enter()
        self.list_of(self.member, "}")
        self.deep -= 1
        self.take("}")

    def member(self):
        if self.got(";"):
            return
        if self.k == "{" or self.k == W["static"] and self.peek() == "{":
            self.word("static")
            self.block()
            return
        self.modifiers()
        if self.is_type_declaration():
            self.type_declaration()
            return
        self.type_parameters()
        self.annotations()
        if self.k in NAMES and self.peek() in "({":  # a constructor
            self.adv()
            if self.k == "(":
                self.rest_of_method(True)
            else:
                self.block()
            return
        if self.k == W["void"]:
            self.adv()
        else:
            self.type()
        if self.peek() == "(":
            self.name()
            self.rest_of_method(False)
        else:
            self.declarators()
            self.semi()

    def rest_of_method(self, constructor: bool):
        self.parameters()
        while self.got("["):
            self.take("]")
        if self.word("throws"):
            self.types()
        if self.word("default"):
            self.element()
        if self.k == "{":
            self.block()
        elif constructor:
            self.bad("expected '{'")
        else:
            self.semi()

    def top(self):
        if self.got(";"):
            return
        at = self.i
        self.modifiers()
        if self.k == W["package"]:
            self.adv()
            self.qualified()
            self.semi()
        elif self.k == W["import"]:
            if self.i != at:
                self.bad()
            self.adv()
            self.word("static")
            self.qualified()
            if self.got("."):
                self.take("*")
            self.semi()
        elif self.is_type_declaration():
            self.type_declaration()
        else:
            self.bad("class, interface, enum or record expected")

    def unit(self):
        while self.k != "\0":
            self.list_of(self.top, "}")
            if self.k == "}":
                self.errors.append((self.i, "unmatched '}'"))
                self.adv()


def check(text: str, lexed: Lexed | None = None) -> list[tuple[int, str]]:
    """All syntax errors as (line, what); an empty list for a valid file."""
    if text[:1] == "\ufeff":
        text, lexed = text[1:], None
    x = lexed or lex(text, "java")

    def parse() -> list[tuple[int, str]]:
        p = Parser(strip(x.kinds))
        try:
            p.unit()
        except Bad as e:
            p.errors.append((e.at, e.why))
        return p.errors

    return positions(x, text, deeply(parse, []))
