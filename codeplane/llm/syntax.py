"""Source files that do not parse, per file and as rates per repository and language.

Each language has a recursive-descent parser with precedence climbing and panic-mode recovery
(``parse_python``, ``parse_js``, ``parse_java``, ``parse_config``).  Files they reject are checked
once more by the standard library where it has a parser, so a rejection is certain there.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import files, map_rows

#: Endings of file names and the languages that they promise.
LANGUAGES = {"py": "python", "js": "javascript", "java": "java", "json": "json", "toml": "toml", "yaml": "yaml"}


def syntax_errors(ending: str, text: str, lexed=None) -> list[tuple[int, str]]:
    """All errors (line, what) of a text in the language of the ending, the first being the cause."""
    if ending == "py":
        from .parse_python import check

        found = check(text, lexed)
        return found if found and not _python_accepts(text) else []
    if ending == "js":
        from .parse_js import check

        return check(text, lexed)
    if ending == "java":
        from .parse_java import check

        return check(text, lexed)
    from .parse_config import check

    found = check(text, ending)
    return found if found and not _library_accepts(ending, text) else []


def _python_accepts(text: str) -> bool:
    import ast
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
            return True
        except (SyntaxError, ValueError, MemoryError, RecursionError):
            return False


def _refuse(constant: str):
    raise ValueError(constant)


def _library_accepts(ending: str, text: str) -> bool:
    import json
    import tomllib

    try:
        if ending == "json":
            json.loads(text, parse_constant=_refuse)
        elif ending == "toml":
            tomllib.loads(text)
        else:
            return False
        return True
    except (ValueError, RecursionError):
        return False


def _each(repo_id, file_path: str, content: str) -> Iterator[tuple]:
    ending = file_path.rpartition(".")[2]
    found = syntax_errors(ending, content or "")
    yield repo_id, file_path, LANGUAGES[ending], not found, len(found), found[0][0] if found else None, found[0][1] if found else None, [{"line": l, "what": w} for l, w in found]


def parse_files(chunks: DataFrame) -> DataFrame:
    """One row per file with one of the six endings: whether it is valid, and all its errors.

    An empty .py, .js, .java, .toml or .yaml file is valid, an empty .json file is not.  Files
    with other endings are no rows.  Null contents count as empty.
    """
    return map_rows(
        files(chunks, LANGUAGES),
        _each,
        "repo_id INT, file_path STRING, language STRING, valid BOOLEAN, n_errors INT, first_line INT, first_cause STRING, errors ARRAY<STRUCT<line: INT, what: STRING>>",
    )


def invalid_files(chunks: DataFrame) -> DataFrame:
    """(repo_id, file_path) of the files that are not valid in the language of their ending."""
    return parse_files(chunks).where("NOT valid").select("repo_id", "file_path")


def syntax_rates(chunks: DataFrame) -> DataFrame:
    """Files, invalid files and their share per repository and language, with totals per language (repo_id null)."""
    parsed = parse_files(chunks).select("repo_id", "language", "valid")
    by = parsed.groupBy("repo_id", "language").agg(F.count("*").alias("n_files"), F.count_if(~F.col("valid")).alias("n_invalid"))
    both = by.groupingSets([[F.col("repo_id"), F.col("language")], [F.col("language")]], F.col("repo_id"), F.col("language")).agg(
        F.sum("n_files").alias("n_files"), F.sum("n_invalid").alias("n_invalid"), F.grouping("repo_id").cast("boolean").alias("is_total")
    )
    return both.withColumn("invalid_rate", F.col("n_invalid") / F.col("n_files"))
