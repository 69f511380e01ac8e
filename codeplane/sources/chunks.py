"""The table of stored chunks as clean chunks and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clean_path


def clean_chunks(chunks: DataFrame) -> DataFrame:
    """One row per (repo_id, clean file_path, ord), the latest of repeated rows; rows without a path are left out.

    Ties of the time go to the greater chunk_id, then to the hash of the content.  One shuffle, which moves the
    columns that the plan asks for, the time, the id and the hash; texts stay where they are read unless they are wanted.
    """
    keys = ("repo_id", "file_path", "ord")
    rows = chunks.withColumn("file_path", clean_path(F.col("file_path"))).where("file_path IS NOT NULL").withColumn("__h", F.xxhash64("content"))
    latest = Window.partitionBy(*keys).orderBy(F.desc("indexed_at"), F.desc("chunk_id"), F.desc("__h"))
    return rows.withColumn("__n", F.row_number().over(latest)).where("__n = 1").select(*chunks.columns)


def files(chunks: DataFrame, endings: tuple[str, ...] | None = None) -> DataFrame:
    """(repo_id, file_path, content): contents of a file's chunks in order, joined by line ends.

    Of repeated rows the latest counts, ties go to the hash of the content; null contents are empty.
    """
    rows = chunks.select("repo_id", clean_path(F.col("file_path")).alias("file_path"), "ord", "indexed_at", F.xxhash64("content").alias("version"), F.coalesce("content", F.lit("")).alias("content")).where("file_path IS NOT NULL")
    if endings:
        rows = rows.where(F.col("file_path").rlike(r"\.(?:" + "|".join(endings) + ")$"))
    parts = rows.groupBy("repo_id", "file_path").agg(F.sort_array(F.collect_list(F.struct("ord", "indexed_at", "version", "content"))).alias("parts"))
    kept = F.filter("parts", lambda x, i: (i == F.size("parts") - 1) | ~F.get(F.col("parts.ord"), i + 1).eqNullSafe(x["ord"]))
    return parts.select("repo_id", "file_path", F.array_join(F.transform(kept, lambda x: x["content"]), "\n").alias("content"))
