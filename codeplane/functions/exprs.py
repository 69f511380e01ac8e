"""Column expressions: intervals, globs, paths, names, texts and vectors.

Every function takes and gives columns and stays in the JVM.  Null arguments give null unless said otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ------------------------------------------------------------------- intervals


def contains_lines(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """[start, end] holds the other range."""
    return (start <= other_start) & (other_end <= end)


def overlaps_one_sided(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """The other range starts or ends inside; one that strictly encloses [start, end] does not count."""
    return other_start.between(start, end) | other_end.between(start, end)


def overlaps_lines(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """The ranges share a line."""
    return ~((end < other_start) | (start > other_end))


def within_lines(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """[start, end] lies in the other range."""
    return (start >= other_start) & (end <= other_end)


def contains_bytes(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Byte containment; raises where a bound is null."""
    known = start.isNotNull() & end.isNotNull() & other_start.isNotNull() & other_end.isNotNull()
    return F.when(known, (start <= other_start) & (other_end <= end)).otherwise(F.raise_error(F.lit("byte range is not set")).cast("boolean"))


def shift(range_: Column, rows: Column | int) -> Column:
    """A range struct(start_row, end_row) moved by a number of rows."""
    return F.struct((range_["start_row"] + rows).alias("start_row"), (range_["end_row"] + rows).alias("end_row"))


# --------------------------------------------------------------- paths and globs


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def clean_path(path: Column) -> Column:
    """Forward slashes and no leading './'."""
    return F.regexp_replace(posix(path), r"^(?:\./+)+", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a glob: '**/' any folders, '*' and '?' within a name, [..] sets."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in pattern[i + 2 :]:
            j = pattern.index("]", i + 2)
            out.append("[" + ("^" + pattern[i + 2 : j] if pattern[i + 1] in "!^" else pattern[i + 1 : j]) + "]")
            i = j
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def fnmatch_regex(pattern: str) -> str:
    """As glob_regex, but '*' also passes slashes."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def matches_any(path: Column, patterns: list[str], whole_path: bool = True) -> Column:
    """Whether one of the globs matches; no pattern matches nothing."""
    regex = "|".join(f"(?:{(glob_regex if whole_path else fnmatch_regex)(p)})" for p in patterns)
    return path.rlike(regex) if patterns else F.lit(False)


def excluded(path: Column, patterns: list[str]) -> Column:
    """One of the patterns matches the path or its last part."""
    return matches_any(path, patterns, False) | matches_any(basename(path), patterns, False)


#: Where tests lie.
TEST_GLOBS = ["**/test/**", "**/tests/**", "**/test_*.py", "**/*_test.py"]


def category(path: Column) -> Column:
    return F.when(matches_any(path, TEST_GLOBS), "test").otherwise("implementation")


#: Media types by ending.
MEDIA_TYPES = {"py": "text/x-python", "js": "text/javascript", "java": "text/x-java-source", "json": "application/json", "toml": "application/toml", "yaml": "application/yaml", "md": "text/markdown", "sh": "application/x-sh"}


def media_type(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.coalesce(table[F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)], F.lit("text/plain"))


def is_test_pattern(pattern: Column) -> Column:
    """A file pattern that asks for tests."""
    return pattern.startswith("test_") | pattern.contains("/test") | pattern.rlike(r"^tests?/|_test\.")


def parser_of(path: Column) -> Column:
    """The parser for a path's ending, null if there is none."""
    return F.when(path.endswith(".py"), "python").when(path.endswith(".java"), "java")


def namespace(name: Column) -> Column:
    """Parts, root, last part and path form of a dotted name."""
    parts = F.split(name, r"\.")
    return F.struct(parts.alias("parts"), F.element_at(parts, 1).alias("root"), F.element_at(parts, -1).alias("leaf"), F.array_join(parts, "/").alias("path"))


# --------------------------------------------------------------------- texts


def without_space(text: Column) -> Column:
    return F.translate(text, " \t\n\r", "")


def contains_unspaced(text: Column, part: Column) -> Column:
    """Containment that ignores white space."""
    return F.contains(without_space(text), without_space(part))


def ignorable_comment(text: Column) -> Column:
    """Empty, or a copyright, licence or author remark."""
    return (F.length(F.trim(text)) == 0) | text.rlike(r"(?i)copyright|license|author")


def occurrences(text: Column, part: str) -> Column:
    return F.size(F.split(text, re.escape(part), -1)) - 1


def is_import_block(text: Column) -> Column:
    """More than three mentions of 'import'."""
    return occurrences(F.lower(text), "import") > 3


def is_placeholder_comment(text: Column) -> Column:
    """A comment that stands for code that was left out."""
    return text.startswith("# ...") | text.rlike(r"(?i)rest of the code|existing code|other code")


def fenced(text: Column, language: str) -> Column:
    """What the (greedy) fenced block of a language holds; the whole text if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(text, rf"(?s)```{language}(.*)```", 1), F.lit("")), text)


def between_tags(text: Column, tag: str) -> Column:
    """All texts between <tag> and </tag>."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), 1)


def double_bracket_refs(text: Column) -> Column:
    """Names in [[...]]."""
    return F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), 1)


def clean_markdown(text: Column) -> Column:
    """Markdown without a fence around it, with single blank lines."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?m)^```(?:markdown|md)?\s*$", ""), r"\n{3,}", "\n\n"))


def github_owner(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^(?:https?://[^/]+/|git@[^:]+:)([^/]+)/", 1), F.lit(""))


def github_repo(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^(?:https?://[^/]+/|git@[^:]+:)[^/]+/([^/]+?)(?:\.git)?/?$", 1), F.lit(""))


def http_to_ssh(url: Column) -> Column:
    return F.regexp_replace(url, r"^https?://([^/]+)/", r"git@$1:")


def snake_case(name: Column) -> Column:
    """CamelCase -> camel_case."""
    return F.lower(F.regexp_replace(name, r"(?<=.)(?=[A-Z])", "_"))


def text_hash(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in columns]), 256)


def word_tokens(text: Column) -> Column:
    """Deterministic token count: words and single other characters."""
    return F.regexp_count(text, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"))


def lines(text: Column, start: int, end: int) -> Column:
    """Lines [start, end) joined, counted from 0."""
    return F.array_join(F.slice(F.split(text, "\n"), start + 1, max(0, end - start)), "\n")


# -------------------------------------------------------------------------------- vectors (G1)


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays of equal length, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
