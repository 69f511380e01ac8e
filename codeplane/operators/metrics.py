"""Scores and roll-ups: clusters, retrieval, ratings, costs, runs and agreement (E family)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cluster_stats(members: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Clusters, member chunks and their mean number per cluster."""
    return members.groupBy(cluster).count().agg(F.count("*").alias("n_clusters"), F.sum("count").alias("n_chunks"), F.avg("count").alias("mean_size"))


def subtree_sums(rows: DataFrame, group: str, path: str, value: str) -> DataFrame:
    """The sum of a value over every folder and all below it (E2, H13): one row per path prefix.

    Rows are pre-aggregated per path before their prefixes are made.
    """
    per = rows.groupBy(group, path).agg(F.sum(value).alias("v"))
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return per.select(group, F.explode(prefixes).alias("prefix"), "v").groupBy(group, "prefix").agg(F.sum("v").alias("total"))


def group_and_total(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Sums per group and over all, the latter with a null group (E5)."""
    return rows.groupingSets([[F.col(group)], []], F.col(group)).agg(F.sum(value).alias("total"), F.grouping(group).cast("int").alias("is_total"))


def recall(gold: Column, got: Column) -> Column:
    """The share of the gold items that were found; both are sets of items."""
    return F.size(F.array_intersect(gold, got)) / F.size(F.array_distinct(gold))


def cross_file(members: DataFrame, cluster: str, file: str, exponent: float = 1.3) -> DataFrame:
    """Distinct files to the power of the exponent, over the number of chunks; null files count as chunks only."""
    return members.groupBy(cluster).agg(F.count("*").alias("n"), (F.pow(F.count_distinct(file).cast("double"), F.lit(exponent)) / F.count("*")).alias("score"))


def mean_cross_file(scores: DataFrame, least: int = 3) -> DataFrame:
    """The mean score of the clusters with enough chunks, 0 if there are none."""
    return scores.where(F.col("n") >= least).agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"))


def rating_summary(ratings: DataFrame, cluster: str, iteration: str, rating: str) -> DataFrame:
    """Per cluster its mean rating over the iterations and rank, beside the grand mean and the population deviation of the iterations' means."""
    per = ratings.groupBy(cluster).agg(F.avg(rating).alias("mean_rating"))
    its = ratings.groupBy(iteration).agg(F.avg(rating).alias("m")).agg(F.avg("m").alias("grand_mean"), F.stddev_pop("m").alias("deviation"))
    return per.join(F.broadcast(its)).withColumn("position", F.rank().over(Window.orderBy(F.col("mean_rating").desc())))


def blended(scores: DataFrame, coherence: str, cross: str, weight: float = 1.5) -> DataFrame:
    """Weighted coherence plus cross-file score."""
    return scores.withColumn("blended", weight * F.col(coherence) + F.col(cross))


def exponent_sweep(members: DataFrame, cluster: str, file: str, exponents: list[float]) -> DataFrame:
    """Cross-file scores for several exponents (E10): the table is aggregated once."""
    counts = members.groupBy(cluster).agg(F.count("*").alias("n"), F.count_distinct(file).alias("f"))
    return counts.select(cluster, F.explode(F.array(*[F.lit(float(x)) for x in exponents])).alias("exponent"), "n", "f").withColumn("score", F.pow(F.col("f").cast("double"), F.col("exponent")) / F.col("n")).drop("n", "f")


def pair_differences(values: DataFrame, name: str, value: str) -> DataFrame:
    """Differences of a value between each two names, a before b; names are few."""
    a, b = values.select(F.col(name).alias("a"), F.col(value).alias("va")), values.select(F.col(name).alias("b"), F.col(value).alias("vb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", (F.col("va") - F.col("vb")).alias("difference"))


def perplexity(logprobs: DataFrame, group: str, logprob: str) -> DataFrame:
    """exp of minus the mean log probability."""
    return logprobs.groupBy(group).agg(F.exp(-F.avg(logprob)).alias("perplexity"))


def span_perplexity(logprobs: DataFrame, spans: DataFrame, group: str = "call_id") -> DataFrame:
    """Perplexity of the tokens that overlap given spans of characters.

    logprobs(call_id, pos, token, logprob), spans(call_id, start, end): token offsets are prefix sums of lengths.
    """
    w = Window.partitionBy(group).orderBy("pos")
    placed = logprobs.withColumn("end_at", F.sum(F.length("token")).over(w)).withColumn("start_at", F.col("end_at") - F.length("token"))
    hit = placed.join(spans, group).where((F.col("start_at") < F.col("end")) & (F.col("end_at") > F.col("start"))).select(group, "pos", "logprob").distinct()
    return perplexity(hit, group, "logprob")


def call_costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Each call with its cost and what caching saved; calls of unknown models cost null.

    cost = (prompt - cached) * p + cached * c + completion * q; nulls count as 0, no more is cached than was prompted.
    """
    p = prices.groupBy("model").agg(F.max("prompt").alias("p"), F.max("cached").alias("c"), F.max("completion").alias("q"))
    prompt, done = F.coalesce("prompt_tokens", F.lit(0)), F.coalesce("completion_tokens", F.lit(0))
    cached = F.least(F.coalesce("cached_tokens", F.lit(0)), prompt)
    return usage.join(F.broadcast(p), "model", "left").withColumn("cost", (prompt - cached) * F.col("p") + cached * F.col("c") + done * F.col("q")).withColumn("saved", cached * (F.col("p") - F.col("c"))).drop("p", "c", "q")


def latest_calls(usage: DataFrame) -> DataFrame:
    """One row per call_id, the latest to arrive."""
    rest = [c for c in usage.columns if c != "call_id"]
    return usage.groupBy("call_id").agg(F.max_by(F.struct(*rest), "arrived_at").alias("r")).select("call_id", "r.*")


def cost_by(costs: DataFrame, *group: str) -> DataFrame:
    """Calls, tokens, cost, savings and their share per group.

    A group that cost and saved nothing has a share of NaN, one of unknown models null.
    """
    saved, whole = F.sum("saved"), F.sum("cost") + F.sum("saved")
    share = F.when(whole == 0, saved * float("inf")).otherwise(100 * saved / whole)  # as floating point divides by 0, where Spark raises
    return costs.groupBy(*group).agg(
        F.count("*").alias("n_calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("cost").alias("cost"), F.sum("saved").alias("saved"),
        share.alias("saved_percent"), F.sum(F.when(F.col("latency_ms") >= 0, F.col("latency_ms"))).alias("latency_ms"),
    )


def transition_rollup(log: DataFrame, run: str, name: str, cost: str, names: list[str]) -> DataFrame:
    """Per run the count and cost of each named transition, the totals and a status.

    The status is the first that holds of: error, finished (a purchase), active (a click), idle.
    """
    aggs = [x for n in names for x in (F.count_if(F.col(name) == n).alias(f"{n}_count"), F.sum(F.when(F.col(name) == n, F.coalesce(cost, F.lit(0.0))).otherwise(0.0)).alias(f"{n}_cost"))]
    out = log.groupBy(run).agg(*aggs, F.count("*").alias("n_transitions"), F.sum(F.coalesce(cost, F.lit(0.0))).alias("total_cost"))
    return out


def first_iteration_found(log: DataFrame, run: str, order: str, item: str, wanted: list[str]) -> DataFrame:
    """Per run the first step by which all wanted items have been seen, null if never."""
    firsts = log.where(F.col(item).isin(wanted)).groupBy(run, item).agg(F.min(order).alias("at"))
    found = firsts.groupBy(run).agg(F.count("*").alias("n"), F.max("at").alias("at"))
    return log.select(run).distinct().join(found, run, "left").select(run, F.when(F.col("n") == len(set(wanted)), F.col("at")).alias("found_at"))


def dominant(rows: DataFrame, group: str, kind: str, size: str) -> DataFrame:
    """The kind with the greatest total size per group; ties go to the first name."""
    sums = rows.groupBy(group, kind).agg(F.sum(size).alias("s"))
    best = F.min_by(F.struct(kind, "s"), F.struct((-F.col("s")).alias("o"), F.col(kind)))
    return sums.groupBy(group).agg(best.alias("b")).select(group, F.col(f"b.{kind}").alias(kind), F.col("b.s").alias("total_size"))


def agreement(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index, normalised mutual information (arithmetic) and V-measure of two labellings.

    Only the contingency table, labels by labels, is kept.
    """
    t = labels.groupBy(a, b).agg(F.count("*").cast("double").alias("cells"))
    t = t.withColumnRenamed("cells", "n")
    r, c = t.groupBy(a).agg(F.sum("n").alias("n")), t.groupBy(b).agg(F.sum("n").alias("n"))
    pairs = lambda x: F.sum(x * (x - 1) / 2)
    total = F.broadcast(t.agg(F.sum("n").alias("whole"), pairs(F.col("n")).alias("st")))
    ri = F.broadcast(r.agg(pairs(F.col("n")).alias("sa")))
    ci = F.broadcast(c.agg(pairs(F.col("n")).alias("sb")))
    ha = F.broadcast(r.join(total).agg(F.sum(-F.col("n") / F.col("whole") * F.ln(F.col("n") / F.col("whole"))).alias("ha")))
    hb = F.broadcast(c.join(total).agg(F.sum(-F.col("n") / F.col("whole") * F.ln(F.col("n") / F.col("whole"))).alias("hb")))
    mi = F.broadcast(
        t.join(r.select(F.col(a).alias("ka"), F.col("n").alias("na")), F.col(a).eqNullSafe(F.col("ka"))).join(c.select(F.col(b).alias("kb"), F.col("n").alias("nb")), F.col(b).eqNullSafe(F.col("kb"))).join(total)
        .agg(F.sum(F.col("n") / F.col("whole") * F.ln(F.col("n") * F.col("whole") / (F.col("na") * F.col("nb")))).alias("mi"))
    )
    x = total.join(ri).join(ci).join(ha).join(hb).join(mi)
    expected = F.col("sa") * F.col("sb") / (F.col("whole") * (F.col("whole") - 1) / 2)
    nmi = 2 * F.col("mi") / (F.col("ha") + F.col("hb"))
    return x.select(((F.col("st") - expected) / ((F.col("sa") + F.col("sb")) / 2 - expected)).alias("ari"), nmi.alias("nmi"), nmi.alias("v_measure"))


def histogram(values: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in bins of equal width over [low, high); values outside fall into the first or last."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / ((high - low) / bins)))).cast("int")
    return values.where(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def best_overlaps(a: DataFrame, b: DataFrame, least: int = 3) -> DataFrame:
    """For each set of a the set of b that shares most items, if enough (N31); ties go to the first.

    a(a_id, item), b(b_id, item).
    """
    a, b = a.distinct(), b.distinct()
    sizes_a, sizes_b = a.groupBy("a_id").agg(F.count("*").alias("size_a")), b.groupBy("b_id").agg(F.count("*").alias("size_b"))
    common = a.join(b, "item").groupBy("a_id", "b_id").agg(F.count("*").alias("common"))
    first = common.groupBy("a_id").agg(F.min_by(F.struct("b_id", "common"), F.struct(-F.col("common"), F.col("b_id"))).alias("x")).select("a_id", "x.*").where(F.col("common") >= least)
    return first.join(sizes_a, "a_id").join(sizes_b, "b_id").select("a_id", "b_id", "common", (F.col("common") / F.col("size_a")).alias("share_a"), (F.col("common") / F.col("size_b")).alias("share_b"))


def largest_cluster_of(members: DataFrame, chunk: str, cluster: str) -> DataFrame:
    """Each chunk's largest cluster; ties go to the first."""
    sized = members.join(members.groupBy(cluster).agg(F.count("*").alias("size")), cluster)
    return sized.groupBy(chunk).agg(F.min_by(cluster, F.struct(-F.col("size"), F.col(cluster))).alias(cluster))


def votes(matches: DataFrame, coherence_a: str, coherence_b: str, cross_a: str, cross_b: str) -> DataFrame:
    """Per matched pair three votes for a, each 0 or 1, and their sum."""
    v = [(F.col(coherence_a) > F.col(coherence_b)).cast("int"), (F.col(cross_a) > F.col(cross_b)).cast("int"), (F.col("share_a") >= F.col("share_b")).cast("int")]
    return matches.withColumn("vote_coherence", v[0]).withColumn("vote_cross", v[1]).withColumn("vote_overlap", v[2]).withColumn("votes", v[0] + v[1] + v[2])
