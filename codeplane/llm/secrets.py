"""Credentials embedded in code, remarks and configuration: found by key name and value shape, redacted in place.

Configuration formats (JSON, TOML, YAML, INI, environment files, netrc) are parsed into key paths
with offsets; every other text is searched on the lines that hint at a credential.  A finding is a
span of the text, so a redaction is a splice and leaves every other byte as it was.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame

from .files import files, map_rows
from .parse_config import json_parse, toml_parse, yaml_parse

# ------------------------------------------------------------- fixed values: names and shapes
#: Names whose value is a credential; the second group only if the value is unmistakable.
STRONG = re.compile(
    r"pass(?:word|wd|phrase|code)|(?<![A-Za-z])pass(?![A-Za-z])|(?<![a-z])pwd?(?![a-z])|(?<![A-Za-z])PWD?(?![A-Za-z])|secret|tokens?(?![a-z])|api[ _.-]?key|access[ _.-]?key|private[ _.-]?key|sign(?:ing)?[ _.-]?key|"
    r"encryption[ _.-]?key|master[ _.-]?key|credentials?|(?<![a-z])creds?(?![a-z])|bearer|authorization|x-api-key|client[ _.-]?secret",
    re.I,
)
WEAK = re.compile(r"(?:^|[_\W]|(?<=[a-z0-9]))(?:key|auth|login|Key|Auth|Login|KEY|AUTH|LOGIN|dsn|salt|cookie|session|DSN|Salt|SALT|Cookie|COOKIE|Session|SESSION)(?![a-z])")
#: Names of things that only speak of credentials, or are no secret.
NO_SECRET = re.compile(
    r"(?:name|field|file|path|header|env|var|type|id|url|uri|pattern|regex|re|prefix|suffix|length|len|size|count|limit|ttl|label|title|class|column|param|dir|endpoint|hint|policy|"
    r"format|kind|scope|expiry|expires|index|position|budget|stdin|prompt)s?$|hash|sha\d*(?![a-z])|md5|digest|checksum|integrity|commit|revision|fingerprint|public|verify|pub[_-]?key|"
    r"tokeni[sz]|tokens?[_-]?(?:count|limit|type|id|max|min|num|per|used)|(?:max|min|num|n|prompt|cached|completion)[_-]?tokens?|primary[_-]?key|foreign[_-]?key|"
    r"key[_-]?(?:path|name|code|word|board|press|up|down|event|id|space)|example|sample|dummy|fake|placeholder|encrypted|sealed",
    re.I,
)
PLACEHOLDER = re.compile(
    r"change[ _-]?me|replace[ _-]?(?:me|this|with)|your[ _-]|<[^>]*>|\*{3,}|x{4,}|\.{3}|example|sample|dummy|fake|placeholder|redacted|to[ _-]?do|fix[ _-]?me|insert|fill[ _-]?in|"
    r"\$\{|\$\(|^\$[A-Z_]\w*$|(?-i:(?:^|[\s:/@=,;-])\$[A-Z_][A-Z0-9_]{2,}|%[A-Z_]{3,}%)|\{\{|%\(|\{[a-z_.\[\]\"']*\}|^env:|^vault|^file:|^ref:|^arn:|^ssm:|^secretsmanager|^op://|^enc[\[(:]|^!vault|process\.env|os\.environ|getenv|"
    r"^(?:none|null|nil|true|false|undefined|default|secret|password|token|test|unset|empty|nothing)$|^(.)\1+$|^\W*$|^0+$|12345678|abcdef|qwerty(?:uiop)?$|lorem|not[ _-]?(?:a[ _-]?)?(?:real|secret)|not[ _-]set",
    re.I,
)
HASHED = re.compile(r"^(?:\$(?:2[abxy]|1|5|6|argon2\w*|scrypt|pbkdf2\S*)\$|sha\d+[-:]|md5[-:]|\{(?:ssha|sha|crypt|md5)\w*\}|pbkdf2_|bcrypt|scrypt:|urn:|git\+|ssh-(?:rsa|ed25519|dss) |ecdsa-)", re.I)
#: What says of a credential that it is none: an example, sample, dummy and the like of a value, or as the last word on it; a 'sample rate' says nothing.
MARKED = re.compile(
    r"made[- ]up|not (?:a )?(?:real|secret|valid)\b|fictional|invented|for illustration|shown in the help|(?:for|as an?|an|an? mere|just an?|only an?)\s+(?:example|sample|dummy|fake|placeholder)s?\b|"
    r"(?<![\w.@/-])(?:examples?|samples?|dummy|fake|placeholder)\b(?!\.\w)(?=\W*$|\s*[:,;)]|\s+(?:\w+\s+)?(?:api|access|secret|private)?[ _-]?(?:keys?|passwords?|passwd|secrets?|tokens?|credentials?|creds|logins?|values?|only|config(?:uration)?|usage|data)\b)",
    re.I,
)
#: Tokens whose issuer is plain from their form.
ISSUED = re.compile(
    r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|glpat-[A-Za-z0-9_-]{20,}|sk-(?:proj-|ant-)?[A-Za-z0-9_-]{24,}|"
    r"[a-z]{2,6}_(?:live|prod|test)_[A-Za-z0-9]{16,}|xox[abeoprs]-[A-Za-z0-9-]{16,}|AIza[0-9A-Za-z_-]{35}|npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_-]{40,}|SG\.[\w-]{16,}\.[\w-]{16,}|"
    r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,})"
)
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_BODY = re.compile(r"(?:\s|\\n|\\r|[\"'+,\\]|[#*/;>| ])*([A-Za-z0-9+/=]{20,})")
URL = re.compile(r"\b[a-z][a-z0-9+.-]{1,30}://([^\s:/@'\"<>`]*):([^\s/@'\"<>`]+)@[\w\[.-]", re.I)
HINTS = (
    "pass pw secret token key cred login auth bearer basic :// -----begin akia asia ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- sk- _live_ _prod_ _test_ sg. eyj xox aiza npm_ pypi- jdbc dsn salt cookie session".split()
    + ["log in", "logs in", "sign in", "signs in", "signed in", " -u", "--user", "--proxy-user"]
)


@lru_cache(maxsize=1)
def _hints():
    """An automaton over the hints, as a function from a text to the ends of their occurrences."""
    try:
        import ahocorasick
    except ImportError:
        each = [re.compile(re.escape(h)).finditer for h in HINTS]
        return lambda lower: sorted(m.end() - 1 for find in each for m in find(lower))
    automaton = ahocorasick.Automaton()
    for h in HINTS:
        automaton.add_word(h, h)
    automaton.make_automaton()
    return lambda lower: (end for end, _ in automaton.iter(lower))


class Finding(NamedTuple):
    start: int
    end: int
    kind: str
    key: str


@lru_cache(maxsize=50_000)
def _name_class(name: str) -> int:
    """2: names a credential; 1: may name one; 0: does not."""
    if NO_SECRET.search(name) and not re.search(r"(?:secret|private|api|access|signing)[_-]?key$|password$|passphrase$", name, re.I):
        return 0
    return 2 if STRONG.search(name) else 1 if WEAK.search(name) else 0


def _classes(v: str) -> int:
    return bool(re.search("[a-z]", v)) + bool(re.search("[A-Z]", v)) + bool(re.search(r"\d", v)) + bool(re.search(r"[^A-Za-z0-9\s]", v))


def _entropy(v: str) -> float:
    n = len(v)
    return -sum(c / n * math.log2(c / n) for c in Counter(v).values())


def secret_like(v: str, sure: bool) -> bool:
    """Whether a value has the shape of a credential; sure: its name says that it is one."""
    if len(v) < 8 or PLACEHOLDER.search(v) or HASHED.search(v) or " " in v.strip() or "\t" in v:
        return False
    if ISSUED.match(v):
        return True
    if re.fullmatch(r"[\w.-]*(?:/[\w.${}-]+)+/?", v) and not (re.search(r"\d", v) and re.search("[A-Z]", v) and re.search("[a-z]", v) and _entropy(v) > 4):
        return False  # a path
    if re.fullmatch(r"[A-Za-z]+(?:[-_.:][A-Za-z]+)*", v):
        # words: a secret only by its mixed case
        return len(v) >= 20 and len(re.findall("[a-z][A-Z]", v)) >= 4 and _entropy(v) > 4 and "-" not in v and "." not in v
    if re.match(r"[a-z][a-z0-9+.-]*://", v, re.I) or re.fullmatch(r"\d{4}-\d\d-\d\d.*|[\d.,:_-]+", v):
        return False
    if re.fullmatch(r"[0-9a-fA-F]+", v):
        return len(v) >= (16 if sure else 32) and len(set(v)) > 5
    c = _classes(v)
    if sure:
        return c >= 3 or c == 2 and bool(re.search(r"\d", v)) and (len(v) >= 12 or bool(re.search(r"[^A-Za-z0-9_-]", v))) and not re.fullmatch(r"[A-Za-z]+[-_ ]?\d{1,3}|(?:[a-z]+_)+\d+|[A-Z]+(?:_[A-Z0-9]+)*", v)
    return c >= 4 and not re.search(r"[(){}\[\]<>;,]", v) or c >= 3 and len(v) >= 20 and _entropy(v) > 3.7 and bool(re.fullmatch(r"[A-Za-z0-9+/=_-]+", v))


_Q = r"(?:[rRbBuUfF]{0,2})(?:\"([^\"\n\\]{4,})\"|'([^'\n\\]{4,})'|`([^`\n\\]{4,})`)"
_NAME = r"([A-Za-z_$][\w.$-]*)"
#: name = "value", name: "value", "name": "value", name := ..., with a type or a fallback before the value
ASSIGN = re.compile(r"(?<![\w$.-])[\"']?" + _NAME + r"[\"']?\]?\s*(?::\s*[A-Za-z][\w\[\]., |]*?(?==))?\s*(?:\|\|=|\?\?=|:=|=>|[=!]==?|=|:(?!:))\s*(?:\(\s*)?(?:[\w.$\[\]\"'()]*\s*(?:\|\||\?\?|\bor\b)\s*)?" + _Q)
CONCAT = re.compile(r"\s*\+?\s*(?:\"([^\"\n\\]*)\"|'([^'\n\\]*)')")
#: ("NAME", "value")
PAIR = re.compile(r"[(,\[]\s*[\"']([\w.-]*[A-Za-z][\w.-]*)[\"']\s*,\s*" + _Q)
#: login = ("user", "value")
TUPLE = re.compile(r"(?<![\w$])[\"']?([\w.$]*(?:auth|login|creds?|credentials?))[\"']?\s*(?:=|:)\s*[(\[]\s*[\"'][^\"'\n]*[\"']\s*,\s*" + _Q, re.I)
#: open("jdbc:...", "user", "value")
CONNECT = re.compile(r"\(\s*[\"'][a-z][a-z0-9+:.-]*:[^\"'\n]*[\"']\s*,\s*[\"'][^\"'\n]*[\"']\s*,\s*" + _Q, re.I)
HEX = re.compile(_NAME + r"\s*=\s*(?:bytes\.fromhex|unhexlify|binascii\.unhexlify|bytearray\.fromhex|Buffer\.from|HexFormat\.of\(\)\.parseHex)\(\s*[\"']([0-9a-fA-F]{16,})[\"']")
BASIC = re.compile(r"\bbasic\s+([A-Za-z0-9+/]{8,}={0,2})(?![A-Za-z0-9+/=])", re.I)
HEADER = re.compile(r"(?:x-[a-z-]*(?:key|token)|authorization|api-key|private-token)[\"']?\s*[:=,]\s*[\"']?(?:(?:bearer|token|apikey)\s+)?([^\s\"'`,;)\\]{8,})", re.I)
SCHEME = re.compile(r"[\"'`:=]\s*(?:bearer|token)\s+([^\s\"'`,;)\\]{8,})", re.I)
OPTION = re.compile(r"--?(?:[a-z-]*password|[a-z-]*passwd|[a-z-]*token|[a-z-]*secret|[a-z-]*api-key|pass)(?:=|\s+)[\"']?([^\s\"'`;|&<>]{6,})", re.I)
#: curl -u user:value
USER = re.compile(r"(?<!\S)(?:-u|--user|--proxy-user)(?:[ \t]+|=|(?<=-u))[\"']?[^\s:\"'<>{}$]+:([^\s\"'`;|&<>]{6,})")
SHELL = re.compile(r"^[ \t]*(?:[#;][ \t]*)?(?:export[ \t]+|set[ \t]+)?([A-Za-z_][\w.-]*)[ \t]*=[ \t]*(?![\"'\s])([^\s#;]+)[ \t]*(?:#.*)?$")
NETRC = re.compile(r"(?<!\S)password\s+(\S+)")
REMARK = re.compile(r"(?:^|\s)(?:\#|//|/\*|\*(?!\w)|;|--\s|<!--|\"\"\")")
SPEAKS = re.compile(r"pass(?:word|wd|phrase)|\bpwd?\b|secret|token|\bkeys?\b|credential|\bcreds?\b|login|logs? in|sign(?:s|ed)? in|\bauth", re.I)


def _value(m: re.Match, first: int) -> tuple[int, int, str] | None:
    for g in range(first, first + 3):
        if m[g] is not None:
            return m.start(g), m.end(g), m[g]
    return None


#: Lines on which a value that is named on the line before them may stand: more than any pattern has gaps.
_BEHIND = re.compile(r"(?:\s*+[^\n]++){0,12}+")


def _line(text: str, a: int, b: int, shell: bool) -> Iterator[Finding]:
    """Findings that begin on the line text[a:b]."""
    line = text[a:b]
    end_of = _BEHIND.match(text, b).end()
    for m in ISSUED.finditer(line):
        if not PLACEHOLDER.search(m[0]):
            yield Finding(a + m.start(), a + m.end(), "issued", "")
    for m in URL.finditer(line):
        user, password = m[1], m[2]
        if len(password) >= 4 and not PLACEHOLDER.search(password) and not re.search(r"[{}$<>*]|^%s$", password + user) and password.lower() not in ("password", "pass", "secret", "pw", "pwd", "user"):
            yield Finding(a + m.start(2), a + m.end(2), "url", "login")
    for m in BASIC.finditer(line):
        try:
            plain = base64.b64decode(m[1] + "=" * (-len(m[1]) % 4), validate=True).decode()
        except ValueError:
            continue
        if ":" in plain and plain.isprintable() and len(plain.partition(":")[2]) >= 4 and not PLACEHOLDER.search(plain):
            yield Finding(a + m.start(1), a + m.end(1), "basic", "authorization")
    for m in HEX.finditer(line):
        if _name_class(m[1]) and len(set(m[2])) > 5:
            yield Finding(a + m.start(2), a + m.end(2), "hex", m[1])
    for pattern, first in ((ASSIGN, 2), (PAIR, 2)):
        for m in pattern.finditer(text, a, end_of):
            if m.start() >= b:
                break
            c = _name_class(m[1])
            if not c:
                continue
            start, end, value = _value(m, first)
            at, whole = m.end(), value
            while pattern is ASSIGN and (n := CONCAT.match(text, at)):
                whole += n[1] if n[1] is not None else n[2]
                at = n.end()
            if secret_like(whole, c == 2) and not PEM.search(whole):
                yield Finding(start, end, "concatenated" if whole != value else "assigned", m[1])
    for m in TUPLE.finditer(text, a, end_of):
        if m.start() >= b:
            break
        start, end, value = _value(m, 2)
        if secret_like(value, True):
            yield Finding(start, end, "login", m[1])
    for m in CONNECT.finditer(text, a, end_of):
        if m.start() >= b:
            break
        start, end, value = _value(m, 1)
        if secret_like(value, True) and _classes(value) >= 3:
            yield Finding(start, end, "login", "connect")
    for m in (*HEADER.finditer(line), *SCHEME.finditer(line), *OPTION.finditer(line), *USER.finditer(line)):
        if secret_like(m[1], True):
            yield Finding(a + m.start(1), a + m.end(1), "header", "")
    if shell:
        m = SHELL.match(line)
        if m and _name_class(m[1]) and secret_like(m[2], _name_class(m[1]) == 2):
            yield Finding(a + m.start(2), a + m.end(2), "assigned", m[1])
        for m in NETRC.finditer(line):
            if secret_like(m[1], True):
                yield Finding(a + m.start(1), a + m.end(1), "login", "password")
    if (m := REMARK.search(line)) and (s := SPEAKS.search(line, m.end())):
        said = line[m.end() :]
        if not re.search(r"\b(?:hash|sha|checksum|commit|digest|revision|fingerprint|public key|integrity|encrypted)", said, re.I):
            for w in re.finditer(r"[^\s\"'`,()]+", line[s.end() :]):
                v = w[0].rstrip(".;:")
                if len(v) >= 8 and re.search(r"\d", v) and secret_like(v, True) and (_classes(v) >= 3 or re.fullmatch("[0-9a-f]{24,}", v)) and not re.search(r"[(){}\[\]<>=]", v.rstrip("=")) and not re.fullmatch(r"[\w./-]+\.\w{1,5}(?::\d+)?|[A-Z]\w*-\d+|v?\d+(?:\.\d+)+[\w.-]*", v):
                    at = a + s.end() + w.start()
                    yield Finding(at, at + len(v), "remark", "")


# ---------------------------------------------------------------- configuration formats
_INI = re.compile(r"^[ \t]*([\w.\- ]+?)[ \t]*[=:][ \t]*(.*?)[ \t]*$", re.M)
_SECTION = re.compile(r"^[ \t]*\[([^\]]+)\]", re.M)


def config_leaves(text: str, ending: str) -> list[tuple[tuple[str, ...], int, int]]:
    """(key path, start, end) of every scalar of a configuration file; what its parser skipped has none."""
    if ending == "json":
        return json_parse(text)[1]
    if ending == "toml":
        return toml_parse(text)[1]
    if ending in ("yaml", "yml"):
        return yaml_parse(text)[1]
    if ending in ("cfg", "ini", "conf", "properties"):
        section: tuple[str, ...] = ()
        out = []
        at = 0
        for l in text.splitlines(keepends=True):
            if m := _SECTION.match(l):
                section = (m[1],)
            elif l.lstrip()[:1] not in ("#", ";", "!") and (m := _INI.match(l.rstrip("\r\n"))):
                a, b = m.span(2)
                if b - a > 1 and l[a] == l[b - 1] and l[a] in "\"'":
                    a, b = a + 1, b - 1
                out.append(((*section, m[1].strip()), at + a, at + b))
            at += len(l)
        return out
    return []


def _leaf(text: str, path: tuple[str, ...], a: int, b: int) -> Finding | None:
    names = [p for p in path if not p.isdigit() and not p.startswith("[")]
    name = names[-1] if names else ""
    value = text[a:b]
    if PEM.search(value) or "\n" in value.strip():
        return None  # key blocks are found in the text
    c = _name_class(name)
    if c and path and path[-1].isdigit() and not re.search(r"(?i)auth|login|cred|pass|secret|token", name):
        c = 0
    if c and secret_like(value, c == 2 or re.search(r"(?i)login$|auth$", name) is not None):
        return Finding(a, b, "config", ".".join(path))
    return None


CONFIG = {"json", "toml", "yaml", "yml", "cfg", "ini", "conf", "properties"}
SHELLS = {"env", "sh", "bash", "netrc", "cfg", "ini", "conf", "properties", "envrc"}


def find(text: str, ending: str) -> list[Finding]:
    """All credentials of a text, by where their value begins; of overlapping findings the longest counts."""
    found: list[Finding] = []
    for m in PEM.finditer(text):
        body = PEM_BODY.match(text, m.end())
        if body and not MARKED.search(text[max(0, m.start() - 120) : m.start()].rpartition("\n")[2]):
            end = text.find("-----END", m.end())
            end = end if end >= 0 else body.end()
            found.append(Finding(m.start(), end, "key block", ""))
    blocks = [(f.start, f.end) for f in found]
    if ending in CONFIG:
        found += [f for path, a, b in config_leaves(text, ending) if b - a >= 8 and (f := _leaf(text, path, a, b))]
    shell = ending in SHELLS
    at, n = 0, len(text)
    lower = text.lower()
    if len(lower) != n:  # a letter whose lower case is longer
        lower = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    for hit in _hints()(lower):
        if hit < at:
            continue
        a = text.rfind("\n", 0, hit) + 1
        b = text.find("\n", hit)
        b = n if b < 0 else b
        stop = b - (b > a and text[b - 1] == "\r")
        line = text[a:stop]
        if not MARKED.search(line):
            found += _line(text, a, stop, shell)
        at = b + 1
    if not found:
        return []
    found.sort(key=lambda f: (f.start, -f.end))
    out: list[Finding] = []
    for f in found:
        if any(a < f.start < b for a, b in blocks):
            continue
        if out and f.start < out[-1].end:
            continue
        out.append(f)
    return out


def redact(text: str, findings: list[Finding]) -> str:
    """The text with every credential replaced so that what surrounds it still parses.

    Hex digits become zeros and Basic logins another login of that form; a key block keeps its markers.
    """
    out, at = [], 0
    for f in findings:
        out.append(text[at : f.start])
        value = text[f.start : f.end]
        if f.kind == "hex":
            out.append("0" * len(value))
        elif f.kind == "basic":
            out.append(base64.b64encode(b"REDACTED:REDACTED").decode())
        elif f.kind == "key block":
            marker = PEM.match(value)[0]
            out.append(marker + re.sub(r"(?<!\\)[A-Za-z0-9+/=]{16,}", "REDACTED", value[len(marker) :]))
        else:
            out.append("REDACTED")
        at = f.end
        if f.kind == "concatenated":
            while n := CONCAT.match(text, at + 1):  # behind the closing quote
                g = 1 if n[1] is not None else 2
                out.append(text[at : n.start(g)])
                at = n.end(g)
    out.append(text[at:])
    return "".join(out)


# --------------------------------------------------------------------------- operators
def _ending(path: str) -> str:
    return path.rpartition("/")[2].rpartition(".")[2].lower()


def _lines(repo_id, path: str, text: str) -> Iterator[tuple]:
    line, at = 1, 0
    for f in find(text or "", _ending(path)):
        line += text.count("\n", at, f.start)
        at = f.start
        yield repo_id, path, line, f.start, f.end, f.kind, f.key


def credentials(chunks: DataFrame) -> DataFrame:
    """One row per credential: its line, offsets into the file's text, kind and key.

    Null or empty texts have none; the whole text of every file is searched.
    """
    return map_rows(files(chunks), _lines, "repo_id INT, file_path STRING, line_no INT, start INT, end INT, kind STRING, key STRING")


def _redacted(repo_id, path: str, text: str) -> Iterator[tuple]:
    found = find(text or "", _ending(path))
    if found:
        yield repo_id, path, len(found), redact(text, found)


def redacted_files(chunks: DataFrame) -> DataFrame:
    """(repo_id, file_path, n_redacted, content) of the files that held credentials, these replaced."""
    return map_rows(files(chunks), _redacted, "repo_id INT, file_path STRING, n_redacted INT, content STRING")
