"""Queries of the training-data operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import docpairs, mixing, packing, provenance, quality, secrets, split, syntax, tokens


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark, d):
    return provenance.not_by_hand(_t(spark, d, "chunks"))


def p1_provenance(spark, d):
    return provenance.provenance(_t(spark, d, "chunks"))


def p2_found(spark, d):
    return syntax.invalid_files(_t(spark, d, "chunks"))


def p2_errors(spark, d):
    return syntax.parse_files(_t(spark, d, "chunks")).where("NOT valid").select("repo_id", "file_path", "language", "n_errors", "first_line", "first_cause", "errors")


def p2_rates(spark, d):
    return syntax.syntax_rates(_t(spark, d, "chunks"))


def p3_tokens(spark, d):
    return tokens.text_tokens(_t(spark, d, "chunks"), _t(spark, d, "documents"))


def p3_budget(spark, d):
    return tokens.token_budget(_t(spark, d, "chunks"), _t(spark, d, "documents"), _t(spark, d, "token_usage"))


def p4_found(spark, d):
    return split.oversized(_t(spark, d, "chunks"), _t(spark, d, "size_limits"))


def p4_pieces(spark, d):
    return split.split_oversized(_t(spark, d, "chunks"), _t(spark, d, "size_limits"))


def p5_found(spark, d):
    return docpairs.documented_functions(_t(spark, d, "chunks")).select("repo_id", "file_path", "func_name", "def_line")


def p5_pairs(spark, d):
    chunks = _t(spark, d, "chunks")
    return docpairs.with_summaries(docpairs.documented_functions(chunks), chunks)


def p6_found(spark, d):
    return secrets.credentials(_t(spark, d, "chunks")).select("repo_id", "file_path", "line_no").distinct()


def p6_redacted(spark, d):
    return secrets.redacted_files(_t(spark, d, "chunks"))


def p7_packed(spark, d):
    return packing.packed(_t(spark, d, "documents"), _t(spark, d, "size_limits"))


def p7_fill(spark, d):
    return packing.fill(packing.packed(_t(spark, d, "documents"), _t(spark, d, "size_limits")))


def p8_drawn(spark, d):
    return mixing.draw(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))[0]


def p8_shares(spark, d):
    return mixing.shares(*mixing.draw(_t(spark, d, "documents"), _t(spark, d, "mix_targets")))


def p9_found(spark, d):
    return quality.judged(_t(spark, d, "documents"), _t(spark, d, "quality_labels")).where("not_prose").select("doc_id")


def p9_statistics(spark, d):
    return quality.judged(_t(spark, d, "documents"), _t(spark, d, "quality_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}


_P4 = r"""
WITH latest AS (
    SELECT repo_id, file_path, ord, content FROM (
        SELECT repo_id, regexp_replace(replace(file_path, '\', '/'), '^(\./)+', '') AS file_path, ord, content, indexed_at FROM chunks WHERE file_path IS NOT NULL
    ) QUALIFY row_number() OVER (PARTITION BY repo_id, file_path, ord ORDER BY indexed_at DESC NULLS LAST) = 1
)
SELECT repo_id, file_path, ord
FROM latest
WHERE len(regexp_extract_all(content, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]')) > (SELECT min(max_tokens) FROM size_limits WHERE purpose = 'chunk_split')
"""


def oracle_sql() -> dict[str, str]:
    return {"p4_found": _P4.replace("\\\\", "\\")}
