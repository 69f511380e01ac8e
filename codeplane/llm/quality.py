"""Text quality: statistics per document, exact ranks per language, and outlier scores from their tails.

Ranks come from a range-partitioned sort: every partition ranks its own rows, and a summary with a few
rows per partition gives the offsets that make the ranks global and ties exact.  A value that a third
of all rows share is spread over partitions by the document's id, so no partition is larger than another.

The tail probabilities of all statistics are summed up with weights, fitted on raters' labels, to a
score; the score decides.  Only where it leaves a document undecided are its running sentences counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .files import checkpointed, map_batches, spread
from .textstats import STATISTICS, figures

#: Which tail of a statistic speaks against prose: -1 small values, 1 great values, 0 both.
SIDES = {
    "mean_word_length": 0, "symbol_ratio": 1, "digit_ratio": 1, "end_punct_share": -1, "short_share": -1, "clean_share": -1, "repeat_share": 1, "mean_line_length": -1, "running_share": -1,
}
#: Weight of every tail, and of their constant, before any label is seen.
PRIOR, PRIOR_CONSTANT = 0.4, -4.0
#: What a departure of a weight from the prior costs, squared; labels outweigh it from some dozens on.
STIFFNESS = 1.0
#: Labelled documents that the weights are fitted on, at most; they are chosen by the hash of their id.
LABEL_SAMPLE = 5000
#: Between these probabilities of being no prose a document is undecided.
UNDECIDED = (0.1, 0.9)
#: An undecided document is prose if running sentences make up this share at least.
PROSE_SHARE = 0.5
#: Documents that a language needs for ranks of its own; the others are ranked among those of FALLBACK, as no statistic in the score is bound to a language.
LEAST_GROUP = 50
#: Group of the documents whose language neither their words nor their record tell, and of rare languages.
FALLBACK = "en"


def language(lang: Column) -> Column:
    """Two lower-case letters from the ways in which a language is written; null stays null."""
    l = F.lower(F.trim(lang))
    return F.when(l.isin("eng", "english"), "en").when(l.isin("deu", "ger", "german", "deutsch"), "de").when(l.isin("fra", "fre", "french", "français"), "fr").when(l.isin("spa", "spanish", "español"), "es").otherwise(
        F.nullif(F.substring(l, 1, 2), F.lit(""))
    )


def _each(ids: list, texts: list, langs: list) -> list[tuple]:
    values, found = figures(texts)
    return [(i, f or l or FALLBACK, *v) for i, l, f, v in zip(ids, langs, found, values)]


def text_statistics(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, its language (by its common words, else as recorded) and the statistics.

    Null and blank texts have zeros.  Whole texts are read.
    """
    fields = ", ".join(f"{s} {'INT' if s.startswith('n_') else 'DOUBLE'}" for s in STATISTICS)
    return map_batches(spread(documents.select("doc_id", "text", language(F.col("lang")).alias("lang"))), _each, f"doc_id BIGINT, language STRING, {fields}")


def _offsets(parts: list) -> list[tuple[int, int, int]]:
    """Per partition of one group, in their order: rows before it, rows less than its least value, rows not greater than its greatest."""
    rows_before, less = 0, []
    value, tied = None, 0  # the greatest value so far and how many rows at the end have it
    for r in parts:
        equal = tied if r["lo"] == value else 0
        less.append((rows_before, rows_before - equal))
        value, tied = r["hi"], r["c_hi"] + (equal if r["lo"] == r["hi"] else 0)
        rows_before += r["n"]
    out = []
    rows_up_to, value, tied = rows_before, None, 0  # the same from the end
    for r, (offset, lo_less) in zip(reversed(parts), reversed(less)):
        equal = tied if r["hi"] == value else 0
        out.append((offset, lo_less, rows_up_to + equal))
        value, tied = r["lo"], r["c_lo"] + (equal if r["lo"] == r["hi"] else 0)
        rows_up_to -= r["n"]
    return out[::-1]


def exact_ranks(df: DataFrame, groups: list[str], value: str, key: str) -> DataFrame:
    """Adds n_less, n_least (rows of the group with a smaller value; with a value not greater) and n_group.

    Exact with any number of ties.  Rows are sorted once by range over (groups, value, key); what reaches
    the driver is one row per partition and group, at most partitions plus groups.  Null values sort first.
    """
    spark = df.sparkSession
    own = "__p"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(parts, *groups, value, key).withColumn(own, F.spark_partition_id()))
    here = Window.partitionBy(own, *groups).orderBy(value)
    local = ranged.withColumn("__less", F.rank().over(here) - 1).withColumn("__least", F.count(F.lit(1)).over(here.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = ranged.groupBy(own, *groups).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    tied = ranged.join(F.broadcast(ends), [own, *groups]).groupBy(own, *groups).agg(F.first("n").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.count_if(F.col(value) == F.col("lo")).alias("c_lo"), F.count_if(F.col(value) == F.col("hi")).alias("c_hi"))
    by: dict[tuple, list] = {}
    for r in sorted(tied.collect(), key=lambda r: r[own]):
        by.setdefault(tuple(r[g] for g in groups), []).append(r)
    rows = []
    for g, rs in by.items():
        total = sum(r["n"] for r in rs)
        rows += [(r[own], *g, float(r["lo"]), float(r["hi"]), *o, total) for r, o in zip(rs, _offsets(rs))]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = f"{own} INT, " + ", ".join(f"{g} {kinds[g]}" for g in groups) + ", lo DOUBLE, hi DOUBLE, offset BIGINT, lo_less BIGINT, hi_least BIGINT, n_group BIGINT"
    corrections = spark.createDataFrame(rows, schema)
    out = local.join(F.broadcast(corrections), [own, *groups])
    return out.select(
        *df.columns,
        F.when(F.col(value) == F.col("lo"), F.col("lo_less")).otherwise(F.col("offset") + F.col("__less")).alias("n_less"),
        F.when(F.col(value) == F.col("hi"), F.col("hi_least")).otherwise(F.col("offset") + F.col("__least")).alias("n_least"),
        "n_group",
    )


def tail_scores(statistics: DataFrame) -> DataFrame:
    """One row per document: doc_id and, per statistic, tail_NAME, the negative logarithm of its tail probability in its language.

    The probability of the lower tail is the share of documents with a value not greater, that of the
    upper tail the share with a value not smaller, that of both twice the smaller of these, 1 at most.
    """
    large = statistics.groupBy("language").agg(F.count("*").alias("__n")).where(F.col("__n") >= LEAST_GROUP).select("language", F.lit(True).alias("__large"))
    grouped = statistics.join(F.broadcast(large), "language", "left").withColumn("group", F.when(F.col("__large"), F.col("language")).otherwise(F.lit(FALLBACK)))
    melted = grouped.select("doc_id", "group", F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).cast("double").alias("value")) for s in SIDES])).alias("x")).select("doc_id", "group", "x.statistic", "x.value")
    ranked = exact_ranks(melted, ["statistic", "group"], "value", "doc_id")
    low, high = F.col("n_least") / F.col("n_group"), (F.col("n_group") - F.col("n_less")) / F.col("n_group")

    def tail(side: int) -> Column:
        return low if side < 0 else high if side else F.least(F.lit(1.0), 2 * F.least(low, high))

    return ranked.groupBy("doc_id").agg(*[F.max(F.when(F.col("statistic") == s, -F.ln(tail(side)))).alias(f"tail_{s}") for s, side in SIDES.items()])


def fit_weights(tails: DataFrame, labels: DataFrame, limit: int = LABEL_SAMPLE) -> list[float]:
    """The constant and the weights of the tails in the order of SIDES, by logistic regression on labelled documents.

    At most ``limit`` labelled documents reach the driver; a document with contradictory labels counts by the
    share of them.  Weights are held near the prior, which is the result without labels, and never fall under 0.
    """
    import numpy as np

    said = labels.where(F.col("label").isin("prose", "not_prose")).groupBy("doc_id").agg(F.avg((F.col("label") == "not_prose").cast("double")).alias("said"))
    known = tails.join(said, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).toPandas()
    prior = np.array([PRIOR_CONSTANT, *[PRIOR] * len(SIDES)])
    if known.empty:
        return prior.tolist()
    x = np.column_stack([np.ones(len(known)), known[[f"tail_{s}" for s in SIDES]].to_numpy(float)])
    t = known["said"].to_numpy(float)
    stiff = STIFFNESS * np.array([0.1, *[1.0] * len(SIDES)])
    w = prior.copy()
    for _ in range(100):  # Newton's steps; the loss is convex
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(stiff), x.T @ (p - t) + stiff * (w - prior))
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return [float(w[0]), *np.maximum(w[1:], 0).tolist()]


def outlier_scores(tails: DataFrame, weights: list[float]) -> DataFrame:
    """Adds score, the weighted sum of the tails, and probability, what it says of the document's being no prose."""
    score = sum((F.col(f"tail_{s}") * w for s, w in zip(SIDES, weights[1:])), F.lit(weights[0]))
    return tails.withColumn("score", score).withColumn("probability", 1 / (1 + F.exp(-F.col("score"))))


def judged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The statistics of each document with its outlier score, what it says, and whether the document is no natural prose.

    The score decides where its probability is outside UNDECIDED (decided_by 'score'); of the others, as an
    exact check, those are no prose in which running sentences make up less than half of the characters
    (decided_by 'sentences').  Null and blank texts, and others without a word, are cases; labels may be empty or contradictory.
    """
    statistics = checkpointed(text_statistics(documents))
    tails = checkpointed(tail_scores(statistics))
    scores = outlier_scores(tails, fit_weights(tails, labels)).select("doc_id", "score", "probability")
    low, high = UNDECIDED
    undecided = F.col("probability").between(low, high)
    return (
        statistics.join(scores, "doc_id")
        .withColumn("decided_by", F.when(undecided, "sentences").otherwise("score"))
        .withColumn("not_prose", (F.col("n_words") == 0) | F.when(undecided, F.col("running_share") < PROSE_SHARE).otherwise(F.col("probability") > high))
    )
