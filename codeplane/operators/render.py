"""Texts made of rows: prompts with spans and line numbers, rows to index, and summaries by a function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered_text(text: Column, first: Column) -> Column:
    """The lines of a text, each behind its number."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda l, i: F.concat(F.lpad((first + i).cast("string"), 6, " "), F.lit("\t"), l)), "\n")


def prompt_pieces(chunks: DataFrame, limit: int, gap: str = "...") -> DataFrame:
    """The pieces of a file's prompt in order (J6): repo_id, file_path, ord, text.

    chunks(repo_id, file_path, ord, start_line, end_line, tokens, span_ids, content): each piece names its spans and numbers
    its lines; where lines are missing between a piece and the one before, a mark stands first. Pieces are shown
    while the tokens of the file stay within the limit; those beyond it are no rows.
    """
    w = Window.partitionBy("repo_id", "file_path").orderBy("ord")
    size = F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0))
    x = chunks.withColumn("__sum", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("__sum") <= limit)
    missing = F.coalesce(F.col("start_line") > F.lag("end_line").over(w) + 1, F.col("start_line") > 1)
    tag = F.concat(F.lit("<span ids='"), F.array_join(F.coalesce("span_ids", F.array().cast("array<string>")), ","), F.lit("'>\n"))
    text = F.concat(F.when(missing, gap + "\n").otherwise(""), tag, numbered_text(F.coalesce("content", F.lit("")), F.col("start_line")), F.lit("\n</span>"))
    return x.select("repo_id", "file_path", "ord", text.alias("text"))


def index_rows(clusters: DataFrame) -> DataFrame:
    """Rows to index from clusters(id, title, summary, chunk_ids) (J9, J15): id, text, chunk_ids, title, type."""
    text = F.concat_ws("\n", "title", "summary")
    return clusters.select("id", text.alias("text"), F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"), "title", F.lit("cluster").alias("type"))


def mapped(rows: DataFrame, text: str, each: Callable[[list], list], name: str) -> DataFrame:
    """Adds a column that a function makes of lists of texts, such as a model's summaries (J13); rows keep their order and count."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*rows.schema.fields, StructField(name, StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = each(batch.column(batch.schema.get_field_index(text)).to_pylist())
            if len(made) != batch.num_rows:
                raise ValueError("the function gave another number of texts")
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow)), pa.array(made, pa.string())], schema=arrow)

    return rows.mapInArrow(run, schema)


def context_rows(spans: DataFrame) -> DataFrame:
    """files(repo_id, file_path, span_ids, json) of a context from its spans(repo_id, file_path, span_id), and back by explode."""
    f = spans.groupBy("repo_id", "file_path").agg(F.sort_array(F.collect_set("span_id")).alias("span_ids"))
    return f.select("repo_id", "file_path", "span_ids", F.to_json(F.struct("file_path", "span_ids")).alias("json"))


def context_spans(files: DataFrame) -> DataFrame:
    """(repo_id, file_path, span_id) from the JSON of context_rows."""
    j = files.select("repo_id", F.from_json("json", "file_path STRING, span_ids ARRAY<STRING>").alias("j"))
    return j.select("repo_id", "j.file_path", F.explode("j.span_ids").alias("span_id"))
