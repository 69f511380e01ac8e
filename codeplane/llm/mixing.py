"""Documents drawn by source so that each source has its target share of the tokens.

A source whose budget exceeds its size is used whole as often as the budget allows (complete epochs);
the rest of the budget is a weighted sample without replacement (Efraimidis and Spirakis): documents are
sorted by an exponential key scaled by their quality weight, and the tokens are summed up to the budget.
The running sums of a source are made from partition offsets, so a source may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import checkpointed, map_batches, spread
from .textstats import running_shares
from .tokens import VOCABULARY, clean_source, merger, shipped

#: Weight of a text without any running sentence, where 1 + this is that of prose.
LEAST_WEIGHT = 0.05


def running_sums(df: DataFrame, group: str, order: list[str], value: str, name: str = "running") -> DataFrame:
    """Adds the sum of ``value`` over the rows of the group up to this one in the given order.

    Rows are sorted by range once; one row per partition and group reaches the driver.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(parts, group, *order).withColumn("__p", F.spark_partition_id()))
    sums = sorted(ranged.groupBy("__p", group).agg(F.sum(value).alias("s")).collect(), key=lambda r: r["__p"])
    total: dict = {}
    rows = []
    for r in sums:
        rows.append((r["__p"], r[group], total.get(r[group], 0)))
        total[r[group]] = total.get(r[group], 0) + int(r["s"] or 0)
    kind = dict(df.dtypes)[group]
    offsets = spark.createDataFrame(rows, f"__p INT, {group} {kind}, __o BIGINT")
    here = Window.partitionBy("__p", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.withColumn("__s", F.sum(value).over(here)).join(F.broadcast(offsets), ["__p", group]).withColumn(name, F.col("__s") + F.col("__o")).drop("__p", "__s", "__o")


def sized(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, weight, n_tokens) of the documents that have a source and a token; a text is read once for both."""
    vocabulary = shipped(documents.sparkSession, vocabulary)

    def each(ids: list, sources: list, texts: list) -> list[tuple]:
        return [(i, s, LEAST_WEIGHT + w, n) for i, s, w, n in zip(ids, sources, running_shares(texts), merger(vocabulary).count(texts)) if n > 0]

    rows = documents.select("doc_id", clean_source(F.col("source")).alias("source"), "text").where("source IS NOT NULL AND text IS NOT NULL")
    return map_batches(spread(rows), each, "doc_id BIGINT, source STRING, weight DOUBLE, n_tokens INT")


def budgets(available: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per target source: its documents and tokens, the tokens to draw, full epochs and the rest.

    Shares are those of the sources that have documents, scaled to sum to 1.  Without a total it is the greatest
    at which every such source can have its share; with one, a source never gives more than its repeats allow.
    """
    t = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    a = available.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("available_tokens"))
    rows = t.join(a, "source", "left").fillna(0, ["n_docs", "available_tokens"])
    present = rows.where("available_tokens > 0 AND target_share > 0 AND max_repeats > 0").agg(
        F.sum("target_share").alias("present"), F.min(F.col("available_tokens") * F.col("max_repeats") / F.col("target_share")).alias("bound")
    )
    wanted = F.lit(total).cast("double") if total is not None else F.col("bound") * F.col("present")
    rows = rows.join(F.broadcast(present)).withColumn("wanted", F.floor(F.col("target_share") / F.col("present") * wanted).cast("bigint"))
    rows = rows.withColumn("budget", F.coalesce(F.least("wanted", F.col("available_tokens") * F.col("max_repeats")), F.lit(0)).cast("bigint"))
    rows = rows.withColumn("epochs", F.when(F.col("available_tokens") > 0, F.floor(F.col("budget") / F.col("available_tokens"))).otherwise(F.lit(0)).cast("int"))
    return rows.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available_tokens")).select("source", "target_share", "max_repeats", "n_docs", "available_tokens", "budget", "epochs", "rest")


def draw(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 42, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(drawn, budgets): drawn has one row per document that is used, with the times it is.

    The same seed draws the same documents, whatever the partitions.
    """
    docs = checkpointed(sized(documents, vocabulary))
    plan = budgets(docs, targets, total)
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    keyed = docs.withColumn("key", -F.ln(uniform) / F.col("weight"))
    summed = running_sums(keyed.join(F.broadcast(plan.select("source")), "source"), "source", ["key", "doc_id"], "n_tokens")
    picked = summed.join(F.broadcast(plan), "source").withColumn("times", F.col("epochs") + (F.col("running") <= F.col("rest")).cast("int"))
    return picked.where("times > 0").select("source", "doc_id", "n_tokens", "weight", "key", "times"), plan


def shares(drawn: DataFrame, plan: DataFrame) -> DataFrame:
    """Per target source: target and reached share, documents, tokens and the most often a document is used."""
    got = drawn.groupBy("source").agg(F.count("*").alias("n_used"), F.sum(F.col("n_tokens") * F.col("times")).alias("drawn_tokens"), F.max("times").alias("most_times"))
    rows = plan.join(got, "source", "left").fillna(0, ["n_used", "drawn_tokens", "most_times"])
    total = got.agg(F.sum("drawn_tokens").alias("total"))
    return rows.join(F.broadcast(total)).select(
        "source", "target_share", (F.coalesce(F.col("drawn_tokens") / F.col("total"), F.lit(0.0))).alias("reached_share"), "max_repeats", "most_times", "n_docs", "n_used", "available_tokens", "budget", "drawn_tokens"
    )
