"""Readers and writers: repositories, JSON lines, graphs, CSV reports, settings and SQLite columns (A family)."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X


def scan_repository(spark: SparkSession, root: str, glob: str = "*.py", exclude: list[str] | None = None) -> DataFrame:
    """(file_path, file_name, file_type, category, content) of the files below a folder that decode as UTF-8.

    Paths are relative to the folder; exclude globs apply to the path or its last part.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = os.path.abspath(root).rstrip("/") + "/"
    path = F.substring_index(F.col("path"), base, -1)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    f = raw.select(path.alias("file_path"), text.alias("content")).where("content IS NOT NULL")
    if exclude:
        f = f.where(~X.excluded(F.col("file_path"), exclude))
    p = F.col("file_path")
    return f.select("file_path", X.basename(p).alias("file_name"), X.media_type(p).alias("file_type"), X.category(p).alias("category"), "content")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema (A17, A20); lines that don't parse give nulls."""
    return spark.read.schema(schema).json(path)


def append_jsonl(df: DataFrame, path: str):
    """Appends rows as JSON lines."""
    df.write.mode("append").json(path)


def write_report(df: DataFrame, path: str, decimals: int = 4):
    """CSV with every field quoted and a comma as decimal mark."""
    cols = [F.translate(F.format_number(c, decimals), ".,", ",").alias(c) if t in ("double", "float") else F.col(c).cast("string").alias(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str):
    """A graph as two tables below a folder."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def read_node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of a node-link JSON document (A10)."""
    doc = spark.read.option("multiLine", True).json(path)
    return doc.select(F.explode("nodes").alias("n")).select("n.*"), doc.select(F.explode("links").alias("l")).select("l.*")


def to_node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row with a node-link JSON text (A9); for graphs of a size that a document may have."""
    n = nodes.agg(F.sort_array(F.collect_list(F.struct(*nodes.columns))).alias("nodes"))
    e = edges.agg(F.sort_array(F.collect_list(F.struct(*edges.columns))).alias("links"))
    return n.join(F.broadcast(e)).select(F.to_json(F.struct(F.lit(True).alias("directed"), F.lit(True).alias("multigraph"), "nodes", "links")).alias("json"))


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], overwrite: bool = False) -> DataFrame:
    """The table at a path; built and written first if it is missing."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if overwrite or not fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")):
        try:
            build().write.mode("overwrite").parquet(path)
        except Exception:
            fs.delete(p, True)
            raise
    return spark.read.parquet(path)


def pending(instances: DataFrame, results: DataFrame, key: str, retry: bool = False) -> DataFrame:
    """Instances without a finished result (A31); with retry those that failed count as unfinished."""
    done = results.where("status IS NOT NULL" + (" AND error IS NULL" if retry else " OR error IS NOT NULL"))
    return instances.join(done.select(key).distinct(), key, "left_anti")


def merged_settings(base: DataFrame, update: DataFrame, key: str, value: str) -> DataFrame:
    """Settings with those of an update written over."""
    u = update.select(key, F.col(value).alias("__u"))
    return base.join(u, key, "full_outer").select(key, F.coalesce("__u", value).alias(value))


#: Column types of SQLite, their Spark types and defaults.
SQLITE_TYPES = {"INTEGER": ("bigint", "0"), "TEXT": ("string", ""), "REAL": ("double", "0.0"), "BLOB": ("binary", None), "BOOLEAN": ("boolean", "false"), "DATETIME": ("timestamp", None), "NUMERIC": ("double", "0")}


def with_column(df: DataFrame, name: str, kind: str, default: str | None = None) -> DataFrame:
    """The table with a new column of an SQLite type, filled with a default (A22, C39); an existing name or unknown type is an error."""
    if kind.upper() not in SQLITE_TYPES:
        raise ValueError(f"unknown column type: {kind}")
    if name in df.columns:
        raise ValueError(f"column exists: {name}")
    spark_type, own = SQLITE_TYPES[kind.upper()]
    return df.withColumn(name, F.lit(default if default is not None else own).cast(spark_type))


def next_report_index(names: DataFrame, name: str = "name") -> DataFrame:
    """One more than the greatest number at the end of the report names."""
    return names.agg((F.coalesce(F.max(F.nullif(F.regexp_extract(name, r"_(\d+)\.\w+$", 1), F.lit("")).cast("int")), F.lit(0)) + 1).alias("next_index"))


def describe(df: DataFrame, table: str) -> DataFrame:
    """Columns of a table with type and nullability."""
    rows = [(table, f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "table_name STRING, column_name STRING, column_type STRING, is_nullable BOOLEAN")
