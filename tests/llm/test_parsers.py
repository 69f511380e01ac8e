import ast
import json
import tomllib
import warnings

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeplane.llm import parse_config, parse_java, parse_js, parse_python
from codeplane.llm.lexing import lex
from codeplane.llm.syntax import syntax_errors

GOOD_PY = [
    "", "# only\n", "x = 1\n", "def f(a, /, b, *, c=1, **k) -> int:\n    return a\n", "async def g():\n    async with a as b, c:\n        await b\n    async for x in y:\n        pass\n",
    "match x:\n    case [1, *rest] if rest:\n        pass\n    case {'a': b, **c} | None:\n        pass\n    case P(x=1) as q:\n        pass\n", "match = 1\ncase = match + 1\nprint(match)\n", "type X[T: int] = list[T]\n",
    "with (open(a) as f, open(b) as g):\n    pass\n", "x = [i for i in range(3) if i if not i]\ny = {**a, 'b': 1}\nz = {*a, 1}\n", "a, *b = c\n(a.b, c[0]) = d\nx: int = 1\nx += yield_ if y else z\n",
    "try:\n    pass\nexcept* E as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    pass\n", "f'{x!r:>{w}} {a if b else c}' 'y'\n", "lambda *a, k=1: (yield)\n", "@a.b(c)\n@d\nclass E(F, metaclass=G): x = 1; y = 2\n", "if a: b = 1\nelif c: pass\nelse: d\n",
    "x = (\n  1,\n  # c\n  2)\n", "if x:\n\ty\n\tz\n", "x = a[1:2, ::3, ...]\nprint(*a, **b, c=1)\n", "def f():\n    '''doc\n  x'''\n    return\n", "from . import a\nfrom ..b import (c as d,\n e,)\nimport f.g as h, i\n", "global_ = 1\nassert a, b\ndel a, b[0]\n", "x = not a in b is not c\n", "s = b'a' b'b'\n",
]
BAD_PY = [
    "x = \n", "def f(:\n  pass\n", "print 'x'\n", "if x\n  y\n", "  x = 1\n", "if x:\ny\n", "def f():\n  a\n b\n", "x = (1\n", "x = 1)\n", "f'{a b}'\n", "'abc\n", "1 = x\n", "f() = 1\n", "x = “a”\n", "<<<<<<< HEAD\n", "else:\n  x\n", "try:\n  x\ny\n", "def f(a=1, b): pass\n",
    "f(a=1, b)\n", "class\n", "x = 0777\n", "a b\n", "for x in:\n  pass\n", "import\n", "from x import\n", "@a\nx = 1\n", "if x:\n\ty\n        z\n", "x +\n", "return = 1\n", "while True print(1)\n", "x\xa0= 1\n", "{1: 2, 3}\n", "[*]\n", "lambda x y: 1\n", "b'a' 'b'\n", "def f():\n",
]


@pytest.mark.parametrize("text", GOOD_PY + BAD_PY)
def test_python_agrees_with_the_standard_parser(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
            valid = True
        except (SyntaxError, ValueError):
            valid = False
    assert (not parse_python.check(text)) == valid, parse_python.check(text)


def test_python_reports_all_errors_in_order():
    found = parse_python.check("x = \ny = 1\nz = )\n")
    assert [line for line, _ in found] == [1, 3]


GOOD_JS = [
    "", "const a = /x[/]y/g.test(b) ? `a${b}` : a / b / c;", "export default class A extends B { #x = 1; static async *m() { yield* a; } get y() { return this.#x } static { a() } }", "let a = 1\nlet b = 2\n", "import x, { y as z } from './a'; export { x as default, z }; export * from 'q';",
    "for (const [a, b] of c) { if (a) continue; else break }", "const { a, b: { c = 1 }, ...d } = e; ({ f: [g] } = h);", "async (x) => { await x; for await (const y of z) {} }", "a ??= b?.c?.[d]?.(e) ?? f; x = y ** -z;", "label: for (;;) { break label }", "switch (a) { case 1: b(); default: c }", "try { a } catch { b } finally { c }",
    "var f = function* () { yield; }; new A; new B.C(d);", "if (a) b; else c\ndo x++; while (x < 5)\nreturn_ = {get: 1, set, async, of: [,,]}", "x = a\n++b", "#!/usr/bin/env node\nf()", "const g = async x => x, h = ({ a }) => ({ ...a });",
]
BAD_JS = ["let x = ;", "function (a) {}", "const a;", "a b", "if (a { }", "{", "}", "x = {a: }", "for (let i = 0; i < 5) {}", "interface A { b: string; }", "let x: number = 1;", "return 1", "class A { foo: 1 }", "import a from b;", "1 = x", "a => { ", "<div></div>", "'abc", "`a${b c}`", "try { }", "const { a } ;", "x = “a”"]


@pytest.mark.parametrize("text", GOOD_JS)
def test_javascript_accepts(text):
    assert parse_js.check(text) == []


@pytest.mark.parametrize("text", BAD_JS)
def test_javascript_rejects(text):
    assert parse_js.check(text)


GOOD_JAVA = [
    "", "package a.b; import java.util.*; import static x.Y.z; public class A<T extends B & C> extends D implements E, F { private final int[] a = {1, 2}; A() { super(); } <R> R f(List<? super T>... x) throws X { return (R) x; } }",
    "interface I { int f(); default void g() { for (int i = 0, j = 1; i < 3; i++) { } } }", "enum E { A(1) { void f() {} }, B; E(int... x) {} }", "record P(int a, String b) { P { } }", "@interface Q { String value() default \"x\"; }",
    "class L { Runnable r = () -> {}; G g = a -> a + 1; H h = String::valueOf; int x = a > b ? c >> 2 : d >>> 3; }",
    "class S { void f() { switch (x) { case 1, 2 -> a(); default -> { } } var y = switch (z) { case 1: yield 2; default: yield 3; }; if (o instanceof String s && !s.isEmpty()) return; synchronized (this) { } try (R r = new R()) { } catch (A | B e) { throw e; } } }",
    'class T { String s = """\n  x "y"\n  """; char c = \'\\u0041\'; long n = 0xFFL; Map<String, List<int[]>> m = new HashMap<>(); int[][] q = new int[3][]; }',
]
BAD_JAVA = ["class A {", "class A { int x = ; }", "class A { void f() { a } }", "x = 1;", "class A { void f() { int x = 1 } }", "class A { public { } } }", "import a", "class A { void f( { } }", "class A { String s = \"x; }", "class A { <<<<<<< HEAD }", "class A { void f() { if a { } } }", "class A { int x\xa0= 1; }"]


@pytest.mark.parametrize("text", GOOD_JAVA)
def test_java_accepts(text):
    assert parse_java.check(text) == []


@pytest.mark.parametrize("text", BAD_JAVA)
def test_java_rejects(text):
    assert parse_java.check(text)


def _json_valid(text):
    def refuse(_):
        raise ValueError

    try:
        json.loads(text, parse_constant=refuse)
        return True
    except ValueError:
        return False


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, true, null, "\\u00e9"]}', "", "[1,]", '{"a" 1}', "01", '"\t"', "NaN", "[]x", "{'a': 1}", '{"a": 1, "a": 2}', "# c\n{}", '"\\x"', " 1 "])
def test_json_agrees_with_the_library(text):
    assert (not parse_config.check(text, "json")) == _json_valid(text)


@settings(max_examples=150, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=5), c, max_size=3), max_leaves=8), st.integers(0, 40), st.sampled_from(["", "x", ",", "}", '"']))
def test_json_agrees_on_damaged_documents(value, at, extra):
    text = json.dumps(value)
    broken = text[:at] + extra + text[at:]
    assert (not parse_config.check(text, "json")) and (not parse_config.check(broken, "json")) == _json_valid(broken)


@pytest.mark.parametrize("text", ["a = 1\na = 2", "[a]\n[a]", "a.b = 1\na.c = 2", "[[a]]\nb = 1\n[[a]]\n[a.c]\nd = 1", "a = [1,\n 2, # c\n]", 'a = """x\ny"""', "a = 1979-05-27T07:32:00Z", "a = 0x_1", "a", "a = {b = 1,}", "a = 01", "a.b = 1\n[a]\nc = 2", "a = inf", 'a = "\\q"', "", "a = 1 b = 2"])
def test_toml_agrees_with_the_library(text):
    try:
        tomllib.loads(text)
        valid = True
    except ValueError:
        valid = False
    assert (not parse_config.check(text, "toml")) == valid


@pytest.mark.parametrize("text", ["a: 1\nb:\n- x\n- y: 2\n  z: 3\n", "a: |\n  text: x\n   more\nb: >-\n  f\n", "{a: 1, b: [x, 'y']}\n", "a: &x 1\nb: *x\n---\nc: d\n", "a: http://x:80/y\n", "- - a\n  - b\n", "", "# c\n", "a: \"x\n  y\"\n", "? a\n: b\n", "plain\ntext\n", "a: !t {b: c}\n"])
def test_yaml_accepts(text):
    assert parse_config.check(text, "yaml") == []


@pytest.mark.parametrize("text", ["a: b: c\n", "a:\n\t- b\n", "- a\nb: c\n", "a: [1, 2\nb: 3\n", "a: @x\n", "a: 1\n  b: 2\n", "a:\n  - 1\n - 2\n", 'x: "a" b\n', "<<<<<<< HEAD\na: 1\n", "a: 'x\n", "a: - b\n"])
def test_yaml_rejects(text):
    assert parse_config.check(text, "yaml")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1 \n\t()[]{}'\"`#/*\\$=.,:;<>xé\u201c\xa0\r", max_size=60), st.sampled_from(["py", "js", "java"]))
def test_lexers_lose_nothing_and_parsers_end(text, language):
    x = lex(text, language)
    assert "".join(x.tokens) == text and len(x.tokens) == len(x.kinds)
    syntax_errors(language, text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab: -\n#[]{},'\"|>&*?!1.", max_size=50), st.sampled_from(["json", "toml", "yaml"]))
def test_config_parsers_end(text, language):
    for line, _ in parse_config.check(text, language):
        assert line >= 1


@pytest.mark.parametrize("text,language", [("x = )\n", "py"), ("x = ];\n", "js"), ("int x = ];\n", "java"), ("a b\n", "toml"), ("- a: @x\n", "yaml")])
def test_all_errors_of_a_file_are_reported(text, language):
    assert [line for line, _ in syntax_errors(language, text * 300)] == [*range(1, 301)]


def test_all_errors_of_a_json_file_are_reported():
    assert len(syntax_errors("json", "[" + "x,\n" * 300 + "1]")) == 300


def test_nesting_is_counted_anew_behind_errors():
    assert "too deeply nested" not in {why for _, why in parse_config.check("a:\n  b:\n    c: @x\n" * 300, "yaml")}
    assert "too deeply nested" not in {why for _, why in syntax_errors("js", "{ if (a) { x = ]; } }\n" * 300)}
