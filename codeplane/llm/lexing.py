"""Lossless lexers for Python, JavaScript and Java.

A file is cut by one regular expression into tokens whose concatenation is the file, so
offsets are prefix sums of token lengths.  Each token then gets a one-character *kind*;
the parsers work on the string of kinds ("signature"), which repeats far more often than
the text does and can therefore be memoised.
"""

from __future__ import annotations

import re
from itertools import accumulate

WS = " \t\f\v\r\n\xa0\ufeff"
#: Tokens longer than this, and any beyond this many, are classified anew each time.
CACHED_LENGTH, CACHED_TOKENS = 32, 400_000


#: A line end is of kind '\\n', several with only white space between them are one token of kind 'N'.
_LINE_END = re.compile("\r\n?|\n|\u2028|\u2029")


class Kinds(dict):
    """Token text -> kind, filled as tokens are met."""

    def __init__(self, classify):
        super().__init__()
        self.classify = classify

    def __missing__(self, token: str) -> str:
        kind = self.classify(token)
        if len(token) <= CACHED_LENGTH and len(self) < CACHED_TOKENS:
            self[token] = kind
        return kind


def _private(words: str) -> dict[str, str]:
    return {w: chr(0x100 + i) for i, w in enumerate(words.split())}


# --------------------------------------------------------------------------- Python
# The reserved words of Python 3 and its soft keywords.
PY_WORDS = _private(
    "False None True and as assert async await break class continue def del elif else except finally for from "
    "global if import in is lambda nonlocal not or pass raise return try while with yield match case type"
)
_PY_OPS = {"**": "P", "//": "D", ">>": "R", "<<": "L", "->": "A", ":=": "W", "...": "0", "!=": "E", "==": "E", "<=": "E", ">=": "E", "<": "E", ">": "E"}
_NUMBER = r"0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][-+]?\d(?:_?\d)*)?[jJ]?"
_PY = re.compile(
    r"[ \t\f]*+(?:[^\W\d]\w*+(?![\"'])|[()\[\]{},;~](?!=)|(?:\r\n?|\n)(?:[ \t\f]*+(?:\r\n?|\n))*+[ \t\f]*+|\.(?![\d.])|=(?!=)|:(?!=)"
    r"|(?:[rRbBfFuU]{1,2})?(?:\"\"\"(?:[^\"\\]++|\\.|\"(?!\"\"))*+\"\"\"|\'\'\'(?:[^\'\\]++|\\.|\'(?!\'\'))*+\'\'\'"
    r"|\"(?!\"\")(?:[^\"\\\r\n]++|\\(?:\r\n|.))*+\"|\"\"(?!\")|\'(?!\'\')(?:[^\'\\\r\n]++|\\(?:\r\n|.))*+\'|\'\'(?!\'))"
    r"|\#[^\r\n]*+|[^\W\d]\w*+|" + _NUMBER + r"|\\(?:\r\n|\r|\n)"
    r"|\*\*=?|//=?|>>=?|<<=?|->|:=|[=!<>]=|[-+*/%&|^@]=|\.\.\.|.)|[ \t\f]++",
    re.S,
)
_PY_STRING = re.compile(r"([a-zA-Z]{0,2})(['\"])")


def _py_kind(token: str) -> str:
    t = token.lstrip(" \t\f")
    if not t:
        return "N" if len(_LINE_END.findall(token)) > 1 else "\n"
    c = t[0]
    if c in "\r\n":
        return "N" if len(_LINE_END.findall(token)) > 1 else "\n"
    if t in PY_WORDS:
        return PY_WORDS[t]
    if c == "#":
        return "#"
    if len(t) > 1 and (m := _PY_STRING.match(t)):
        p = m[1].lower()
        if p not in ("", "r", "b", "f", "u", "rb", "br", "rf", "fr"):
            return "?"
        return "f" if "f" in p else "b" if "b" in p else "s"
    if c == "_" or c.isalpha() or c.isidentifier():
        return "n"
    if c.isdigit() or c == "." and len(t) > 1 and t != "...":
        if not t.isascii() or re.match(r"0[0-9_]*[1-9][0-9_]*$", t):
            return "?"
        return "0"
    if c == "\\":
        return "\\" if len(t) > 1 else "?"
    if t in _PY_OPS:
        return _PY_OPS[t]
    if len(t) > 1 and t[-1] == "=":
        return "G"
    return c if t in "()[]{},:;.=@+-*/%&|^~" else "?"


PY_KINDS = Kinds(_py_kind)

# ----------------------------------------------------------------------- JavaScript
# The reserved words of ECMAScript and the contextual ones the grammar asks for.
JS_WORDS = _private(
    "break case catch class const continue debugger default delete do else export extends finally for function if import in "
    "instanceof new return super switch this throw try typeof var void while with yield let static async await of get set "
    "null true false enum"
)
_JS_OPS = {
    "=>": "A", "===": "E", "!==": "E", "==": "E", "!=": "E", "<=": "<", ">=": "<", "<": "<", ">": "<", "&&": "&", "||": "o", "??": "q", "?.": "Q",
    "**": "P", "++": "I", "--": "I", "<<": "S", ">>": "S", ">>>": "S", "...": "D", "&": "a", "|": "p", "^": "x",
}
_JS_RE = r"/(?![*/])(?:[^/\\\[\r\n]++|\\.|\[(?:[^\]\\\r\n]++|\\.)*+\])+/[A-Za-z]*"
_JS_WS = r"[ \t\f\v\xa0\ufeff]*"
_JS = re.compile(
    _JS_WS + r"+(?:(?!(?:return|typeof|case|in|of|delete|void|throw|new|do|else|yield|await)(?![\w$]))[A-Za-z_$][\w$]*+(?![^\W\d])|[)\]]|\.(?![.\d])|(?:\r\n?|\n|\u2028|\u2029)(?:" + _JS_WS + r"+(?:\r\n?|\n|\u2028|\u2029))*+" + _JS_WS + "+"
    r"|[(,:\[{};](?!\s*+/)"
    r"|//[^\r\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/"
    r"|(?:=>|[=!]==?|&&|\|\||\?\?|\.\.\.|[-+*%&|^<>]=|[(,=:\[!&|?{};~^%+*<>-]|(?<![\w$.])(?:return|typeof|case|in|of|delete|void|throw|new|do|else|yield|await)(?![\w$]))\s*+" + _JS_RE +
    r"|\"(?:[^\"\\\r\n]++|\\(?:\r\n|.))*+\"|'(?:[^'\\\r\n]++|\\(?:\r\n|.))*+'"
    r"|`(?:[^`\\$]++|\\.|\$(?!\{)|\$\{(?:[^{}`]++|\{(?:[^{}]|\{[^{}]*\})*\}|`(?:[^`\\]|\\.)*`)*\})*+`"
    r"|\#?[A-Za-z_$\u0080-\u009f\u00a1-\u1fff\u2c00-\ufefe\uff00-\U0010ffff][\w$]*+"
    r"|0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][-+]?\d+)?n?"
    r"|>>>=|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|\.\.\.|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\*\*|\+\+|--|<<|>>|[-+*/%&|^]=|.)|[ \t\f\v\xa0\ufeff]++",
    re.S,
)
_JS_SPLIT = re.compile(r"(.*?)(\s*" + _JS_RE + r")\Z", re.S)


def _js_kind(token: str) -> str:
    t = token.lstrip(WS)
    if not t:
        return "N" if len(_LINE_END.findall(token)) > 1 else "\n"
    if t in JS_WORDS:
        return JS_WORDS[t]
    c = t[0]
    if t in _JS_OPS:
        return _JS_OPS[t]
    if c == "/" and t[1:2] == "/":
        return "#"
    if c == "/" and t[1:2] == "*":
        return "#"
    if c in "\"'":
        return "s" if len(t) > 1 else "?"
    if c == "`":
        return "t" if len(t) > 1 else "?"
    if c.isdigit() or c == "." and t[1:2].isdigit():
        return "0" if t.isascii() and not t.endswith("_") else "?"
    if c == "_" or c == "$" or c.isalpha() or (c == "#" and len(t) > 1):
        return "n"
    if len(t) > 1 and "/" in t and not t.endswith("="):
        m = _JS_SPLIT.match(token)
        return _js_kind(m[1]) + "r" if m and m[1].strip() else "r"
    if len(t) > 1 and t[-1] == "=":
        return "G"
    return c if t in "()[]{},:;.=?!~+-*/%" else "@" if t == "@" else "?"


def _js_word_regex(token: str) -> str:
    """Kinds of a word or operator that is followed by a regular-expression literal are two."""
    t = token.lstrip(WS)
    if len(t) > 3 and t[0].isalpha() and "/" in t:
        m = _JS_SPLIT.match(token)
        if m and m[1].strip():
            return _js_kind(m[1]) + "r"
    return _js_kind(token)


JS_KINDS = Kinds(_js_word_regex)

# ----------------------------------------------------------------------------- Java
# The reserved words of Java and the contextual ones the grammar asks for.
JAVA_WORDS = _private(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally "
    "float for goto if implements import instanceof int interface long native new package private protected public return "
    "short static strictfp super switch synchronized this throw throws transient try void volatile while true false null "
    "record var yield sealed permits"
)
_JAVA_OPS = {"==": "E", "!=": "E", "<=": "C", ">=": "C", "&&": "&", "||": "o", "++": "I", "--": "I", "->": "A", "::": "M", "...": "D", "&": "a", "|": "p", "^": "x", "<<": "S"}
_JAVA = re.compile(
    r"[ \t\f]*+(?:[A-Za-z_$\u0080-\uffff][\w$]*+|[()\[\]{},;@?~]|(?:\r\n?|\n)(?:[ \t\f]*+(?:\r\n?|\n))*+[ \t\f]*+|//[^\r\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/"
    r"|\"\"\"[ \t\f]*\r?\n(?:[^\"\\]++|\\.|\"(?!\"\"))*+\"\"\"|\"(?:[^\"\\\r\n]++|\\.)*+\"|'(?:[^'\\\r\n]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|.))'"
    r"|0[xX][0-9a-fA-F_.]+(?:[pP][-+]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][-+]?\d+)?[lLfFdD]?"
    r"|>>>=|<<=|>>=|\.\.\.|->|::|==|!=|<=|>=|&&|\|\||\+\+|--|<<|[-+*/%&|^]=|.)|[ \t\f]++",
    re.S,
)


def _java_kind(token: str) -> str:
    t = token.lstrip(" \t\f")
    if not t:
        return "N" if len(_LINE_END.findall(token)) > 1 else "\n"
    c = t[0]
    if c in "\r\n":
        return "N" if len(_LINE_END.findall(token)) > 1 else "\n"
    if t in JAVA_WORDS:
        return JAVA_WORDS[t]
    if t in _JAVA_OPS:
        return _JAVA_OPS[t]
    if c == "/" and t[1:2] in ("/", "*"):
        return "#"
    if c in "\"'":
        return "s" if len(t) > 1 else "?"
    if c.isdigit() or c == "." and t[1:2].isdigit():
        return "0" if t.isascii() and t[-1] != "_" else "?"
    if c == "_" or c == "$" or c.isalpha():
        return "n" if t.replace("$", "_").isidentifier() else "?"
    if len(t) > 1 and t[-1] == "=":
        return "G"
    return c if t in "()[]{},:;.=?!~+-*/%<>@" else "?"


JAVA_KINDS = Kinds(_java_kind)


class Lexed:
    """Tokens of a text, their kinds (one character each), and offsets on demand."""

    __slots__ = ("tokens", "kinds", "_ends")

    def __init__(self, tokens: list[str], kinds: str):
        self.tokens, self.kinds, self._ends = tokens, kinds, None

    def end(self, i: int) -> int:
        if self._ends is None:
            self._ends = list(accumulate(map(len, self.tokens)))
        return self._ends[i]

    def start(self, i: int) -> int:
        """Offset of token i without the white space before it."""
        t = self.tokens[i]
        return self.end(i) - len(t.lstrip(WS) if t.strip(WS) else t)


_BY = {"py": (_PY, PY_KINDS), "js": (_JS, JS_KINDS), "java": (_JAVA, JAVA_KINDS)}


def lex(text: str, language: str) -> Lexed:
    """Tokens of the whole text; nothing is dropped but white space at the very end."""
    pattern, kinds = _BY[language]
    tokens = pattern.findall(text)
    each = [*map(kinds.__getitem__, tokens)]
    joined = "".join(each)
    if len(joined) != len(tokens):
        out_t, out_k = [], []
        for t, k in zip(tokens, each):
            if len(k) == 2:
                m = _JS_SPLIT.match(t)
                out_t += [m[1], m[2]]
                out_k.append(k)
            else:
                out_t.append(t)
                out_k.append(k)
        tokens, joined = out_t, "".join(out_k)
    return Lexed(tokens, joined)
