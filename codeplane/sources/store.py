"""Indexes and databases kept in folders: vectors, bundles of tables, lists of databases."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vectors import apply_deletes
from .io import with_column


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the session's spark.checkpoint.dir names, which all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="store")
    return f"{base.rstrip('/')}/store-{uuid.uuid4().hex}"


def persist_vectors(store: DataFrame, path: str, deleted: DataFrame | None = None, ref: str = "ref_id"):
    """Writes a vector table, without the vectors of deleted documents."""
    (store if deleted is None else apply_deletes(store, deleted, ref)).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """A vector table as it was persisted."""
    return spark.read.parquet(path)


def persist_bundle(tables: dict[str, DataFrame], path: str):
    """Writes the tables of an index below one folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def restore_bundle(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of an index from its folder."""
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def find_databases(spark: SparkSession, folder: str, glob: str = "*.db") -> DataFrame:
    """(path, size, is_valid) of the database files below a folder (A21, A32); a valid one begins with SQLite's header."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return f.select("path", F.col("length").alias("size"), (F.substring(F.col("content"), 1, 15) == F.lit(bytearray(b"SQLite format 3"))).alias("is_valid"))


def with_column_in_all(tables: dict[str, DataFrame | None], name: str, kind: str, default: str | None = None) -> dict[str, DataFrame]:
    """with_column for every table that is there and lacks the column; the others are skipped."""
    return {n: with_column(df, name, kind, default) for n, df in tables.items() if df is not None and name not in df.columns}


def truncated(df: DataFrame, confirm: bool) -> DataFrame:
    """The table without its rows, if that is confirmed."""
    return df.where("false") if confirm else df


def listing(folder: str, ending: str) -> list[str]:
    """Names of the files of a local folder with an ending, in order."""
    return sorted(n for n in os.listdir(folder) if n.endswith(ending))
