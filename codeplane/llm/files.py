"""Files put together from stored chunks, and a helper that maps rows in Python in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a Python worker turns into objects at once; bounds its memory whatever Spark's batch size is.
SLICE = 256


def clean_path(path: Column) -> Column:
    """Forward slashes, no leading './'; null stays null."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(?:\./+)+", "")


def extension(path: Column) -> Column:
    """The ending of the path behind its last dot, lower case; '' if the name has none."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def distinct_chunks(chunks: DataFrame, *columns: str) -> DataFrame:
    """One row per (repo_id, clean file_path, ord) with the latest values of ``columns``.

    Rows without a path name no file and are left out.  Of repeated rows the one with the latest
    indexed_at counts (ties: the greatest hash of the content, as in files()), a null time is the earliest.
    Only the columns asked for and the hash are shuffled; ``version`` may stand for it, where content is no longer whole.
    """
    rest = [c for c in columns if c not in ("repo_id", "file_path", "ord")]
    hashed = F.col("version") if "version" in chunks.columns else F.xxhash64("content")
    rows = chunks.select("repo_id", clean_path(F.col("file_path")).alias("file_path"), "ord", F.struct("indexed_at", hashed.alias("__h"), *[c for c in rest if c != "indexed_at"]).alias("row")).where("file_path IS NOT NULL")
    last = rows.groupBy("repo_id", "file_path", "ord").agg(F.max("row").alias("row"))
    return last.select("repo_id", "file_path", "ord", *[F.col(f"row.{c}").alias(c) for c in rest])


def files(chunks: DataFrame, endings: Iterable[str] | None = None) -> DataFrame:
    """(repo_id, file_path, content): one row per file.

    A file's text is the contents of its chunks in order of ord, joined by line ends; a repeated ord
    counts once, with its latest content (ties: the greatest hash), and a null content is an empty one.  Only the chunks of one
    file meet in a task, so a repository of any size is spread over all of them.
    """
    rows = chunks.select("repo_id", clean_path(F.col("file_path")).alias("file_path"), "ord", "indexed_at", F.xxhash64("content").alias("version"), F.coalesce("content", F.lit("")).alias("content")).where("file_path IS NOT NULL")
    if endings is not None:
        rows = rows.where(F.col("file_path").rlike(r"\.(?:" + "|".join(endings) + r")$"))
    parts = rows.groupBy("repo_id", "file_path").agg(F.sort_array(F.collect_list(F.struct("ord", "indexed_at", "version", "content"))).alias("parts"))
    single = F.size("parts") == 1
    kept = F.filter("parts", lambda x, i: (i == F.size("parts") - 1) | ~F.get(F.col("parts.ord"), i + 1).eqNullSafe(x["ord"]))
    text = F.when(single, F.col("parts")[0]["content"]).otherwise(F.array_join(F.transform(kept, lambda x: x["content"]), "\n"))
    return parts.select("repo_id", "file_path", text.alias("content"))


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where a small input has fewer partitions than these; larger inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def map_rows(df: DataFrame, each: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """Calls ``each(*values of a row)`` for every row; what it yields are the rows of the result.

    Runs in Arrow batches, a slice at a time; rows are neither shuffled nor kept.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    names = arrow.names

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out: list[tuple] = []
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    out.extend(each(*row))
                if out:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))), schema=arrow)

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, each: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """Calls ``each(*lists of values of the columns)`` for some hundred rows at a time; what it returns are the rows of the result."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    names = arrow.names

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                if out := each(*(c.to_pylist() for c in batch.slice(at, SLICE).columns)):
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))), schema=arrow)

    return df.mapInArrow(run, schema)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written once to the folder that the session's spark.checkpoint.dir names.

    Where none is set a temporary folder serves a local session; on a cluster, where executors would not share it, that is an error.
    """
    import tempfile

    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
