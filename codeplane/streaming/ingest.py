"""Incremental ingestion: each micro-batch of documents is compared with the store by content hash and written over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import text_hash
from ..operators.vectors import ingest_diff


def hashed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Documents with the hash of their text."""
    return docs.withColumn("hash", text_hash(F.col(text)))


def apply_batch(spark: SparkSession, batch: DataFrame, store: str, version: int, key: str = "id", text: str = "text") -> DataFrame:
    """Writes version ``version`` of the store: the last one with a batch's inserts and updates; returns the actions.

    A version is a folder of its own, so a batch that is replayed after a failure writes the same folder again.
    """
    known = hashed(batch, key, text)
    # of several texts for a key in a batch the one with the greatest hash counts, however often the batch is replayed
    new = known.groupBy(key).agg(F.max_by(F.struct(*[c for c in known.columns if c != key]), "hash").alias("r")).select(key, "r.*").select(*known.columns)
    old = spark.read.parquet(f"{store}/v={version - 1}") if version > 0 else new.limit(0)
    actions = ingest_diff(old.join(new.select(key), key, "left_semi"), new, [key])
    kept = old.join(new.select(key), key, "left_anti")
    kept.unionByName(new).write.mode("overwrite").parquet(f"{store}/v={version}")
    return actions


def ingest(stream: DataFrame, store: str, checkpoint: str, key: str = "id", text: str = "text"):
    """A streaming query that keeps the store up to date."""
    spark = stream.sparkSession
    return stream.writeStream.foreachBatch(lambda batch, n: apply_batch(spark, batch, store, n, key, text)).option("checkpointLocation", checkpoint).start()
