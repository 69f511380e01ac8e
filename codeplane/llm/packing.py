"""Containers of fixed capacity filled with texts of varying length: harmonic packing, worker by worker.

Lengths fall into classes by reciprocals of the capacity C: class k holds the lengths in (C/(k+1), C/k],
of which any k fit together.  Every worker fills the bins of each class with that fixed count, apart from
all other classes and workers.  A second step then dissolves bins of small items whose contents fit into
the gaps of other bins of the same worker.  A text over the capacity is cut; its full parts are bins by themselves.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import checkpointed, spread
from .tokens import VOCABULARY, with_tokens

#: Classes with a bin count of their own; the last one holds all shorter items, as many to a bin as fit.
CLASSES = 24
#: Items that one worker packs at a time, about; more keep less space, fewer spread further.
ITEMS = 20_000


def by_class(sizes: list[int], capacity: int, classes: int = CLASSES) -> list[tuple[int, list[int]]]:
    """(class, indexes into sizes) of bins; each size is at most the capacity, and each item is in one bin.

    A bin of class k holds k items, but for the last bin of the class; those of the last class are filled in order of size.
    """
    members: dict[int, list[int]] = {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        members.setdefault(min(classes, capacity // sizes[i]) if sizes[i] else classes, []).append(i)
    bins: list[tuple[int, list[int]]] = []
    for k, items in sorted(members.items()):
        if k < classes:
            bins += [(k, items[at : at + k]) for at in range(0, len(items), k)]
            continue
        box, room = [], capacity
        for i in items:
            if sizes[i] > room:
                bins.append((k, box))
                box, room = [], capacity
            box.append(i)
            room -= sizes[i]
        bins.append((k, box))
    return bins


def fill_gaps(bins: list[tuple[int, list[int]]], sizes: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """The bins without those whose items all fit into the gaps of others, each into the smallest that takes it.

    Bins are tried from the emptiest of the smallest items on.
    """
    room = [capacity - sum(sizes[i] for i in box) for _, box in bins]
    gaps = sorted((r, b) for b, r in enumerate(room) if r)
    boxes = [[*box] for _, box in bins]
    total = sum(r for r, _ in gaps)
    for b in sorted(range(len(bins)), key=lambda b: (-bins[b][0], -room[b], b)):
        load = capacity - room[b]
        if total - room[b] < load:
            continue
        if room[b]:
            del gaps[bisect_left(gaps, (room[b], b))]
        placed: list[tuple[int, int]] = []
        for i in sorted(boxes[b], key=lambda i: -sizes[i]):
            at = bisect_left(gaps, (sizes[i], -1))
            if at == len(gaps):
                break
            r, to = gaps.pop(at)
            placed.append((i, to))
            room[to] = r - sizes[i]
            if room[to]:
                insort(gaps, (room[to], to))
        if len(placed) == len(boxes[b]):
            for i, to in placed:
                boxes[to].append(i)
            boxes[b] = []
            total -= room[b] + load
        else:
            for i, to in reversed(placed):
                if room[to]:
                    del gaps[bisect_left(gaps, (room[to], to))]
                room[to] += sizes[i]
                insort(gaps, (room[to], to))
            if room[b]:
                insort(gaps, (room[b], b))
    return [(k, box) for (k, _), box in zip(bins, boxes) if box]


def harmonic(sizes: list[int], capacity: int, classes: int = CLASSES) -> list[list[int]]:
    """Bins of indexes into sizes after both steps."""
    return [box for _, box in fill_gaps(by_class(sizes, capacity, classes), sizes, capacity)]


_BINS = "purpose STRING, class INT, worker BIGINT, bin INT, position INT, doc_id BIGINT, token_start INT, n_tokens INT, capacity INT"


def _packer(gaps: bool):
    def pack(frame):
        import pandas as pd

        purpose, worker, capacity = frame["purpose"].iat[0], int(frame["worker"].iat[0]), int(frame["capacity"].iat[0])
        frame = frame.sort_values(["doc_id", "token_start"])  # the same bins, however rows arrive
        docs, starts, sizes = frame["doc_id"].tolist(), frame["token_start"].tolist(), frame["n_tokens"].tolist()
        bins = by_class(sizes, capacity)
        if gaps:
            bins = fill_gaps(bins, sizes, capacity)
        rows = [(purpose, k, worker, b, position, docs[i], starts[i], sizes[i], capacity) for b, (k, box) in enumerate(bins) for position, i in enumerate(box)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _BINS.split(", ")])

    return pack


def packed(
    documents: DataFrame, limits: DataFrame, purposes: tuple[str, ...] = ("prompt_pack", "train_pack", "embed_pack"), vocabulary: str = VOCABULARY, items: int = ITEMS, gaps: bool = True
) -> DataFrame:
    """One row per text, or per part of a text that exceeds the capacity, with its container (purpose, worker, bin) and the container's class.

    A text of more tokens than the capacity C is cut every C tokens; each full part is a container of class 0
    (its worker is the text's id, its bin the part), and the last part is packed like a text.  Null and empty
    texts have no tokens and are in no container.  Workers are chosen by the hash of the text's id, so none is
    larger than another; without gaps, at most one bin per class and worker holds fewer items than its class.
    """
    sizes = checkpointed(with_tokens(spread(documents.select("doc_id", "text")), "text", vocabulary).where("n_tokens > 0"))
    workers = max(1, -(-sizes.count() // items))
    capacity = limits.where(F.col("purpose").isin(*purposes)).where("max_tokens > 0").groupBy("purpose").agg(F.min("max_tokens").alias("capacity"))
    rows = sizes.join(F.broadcast(capacity)).withColumn("n_full", F.floor(F.col("n_tokens") / F.col("capacity")).cast("int"))
    full = rows.where("n_full > 0").withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("n_full") - 1)))
    full = full.select("purpose", F.lit(0).alias("class"), F.col("doc_id").alias("worker"), "bin", F.lit(0).alias("position"), "doc_id", (F.col("bin") * F.col("capacity")).alias("token_start"), F.col("capacity").alias("n_tokens"), "capacity")
    rest = rows.withColumn("token_start", F.col("n_full") * F.col("capacity")).withColumn("n_tokens", F.col("n_tokens") - F.col("token_start")).where("n_tokens > 0")
    rest = rest.withColumn("worker", F.pmod(F.xxhash64("doc_id"), F.lit(workers)).cast("int")).select("purpose", "worker", "capacity", "doc_id", "token_start", "n_tokens")
    return rest.groupBy("purpose", "worker").applyInPandas(_packer(gaps), _BINS).unionByName(full)


def fill(bins: DataFrame) -> DataFrame:
    """Per purpose: containers, items, tokens, the least number of containers that could do, and the share of space used."""
    each = bins.groupBy("purpose", "class", "worker", "bin").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n"), F.max("capacity").alias("capacity"))
    return each.groupBy("purpose").agg(
        F.count("*").alias("n_bins"), F.sum("n").alias("n_items"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"), F.max("capacity").alias("capacity"),
    ).withColumn("least_bins", F.ceil(F.col("n_tokens") / F.col("capacity"))).withColumn("fill_rate", F.col("n_tokens") / (F.col("n_bins") * F.col("capacity")))
