"""Token counts under a public byte-pair vocabulary, per text and as budgets per slice of the corpus.

Texts are split into pieces; a piece's bytes are an array of symbols, and each distinct piece of a slice
of rows is merged once: adjacent pairs are joined with the table of merge ranks, the lowest-ranked merge
of every piece is applied, and so on until no pair has a rank.  All pieces advance together in arrays;
a long piece keeps its pairs in a heap.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import clean_path, extension, spread

#: Where the vocabulary's ranks are by default; every function takes another path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces whose counts a worker remembers, at most.
REMEMBERED = 1_000_000
SLICE = 256
#: Bytes from which a piece is merged by itself with a heap; shorter ones advance together.
LONG = 128

# The pattern that splits text before merging, and its form for ASCII texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]++| ?[0-9]++| ?[^\sA-Za-z0-9]++|\s+(?!\S)|\s+")
_ODD = re.compile(r"[\x1c-\x1f]")


class Merger:
    """Counts tokens of pieces by repeated merging."""

    def __init__(self, path: str):
        import numpy as np

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.pairs = pairs
        keys = np.fromiter(pairs.keys(), dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.merged = np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))[order]
        self.counts: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        if text.isascii() and not _ODD.search(text):
            return _ASCII.findall(text)
        return _unicode().findall(text)

    def learn(self, pieces: set[str]):
        """Counts of pieces that are not yet known."""
        import numpy as np

        if len(self.counts) + len(pieces) > REMEMBERED:
            self.counts.clear()
        rest: list[tuple[str, bytes]] = []
        for p in pieces:
            b = p.encode("utf-8", "surrogatepass")
            if b in self.ranks:
                self.counts[p] = 1
            elif len(b) > LONG:
                self.counts[p] = self._long(b)
            else:
                rest.append((p, b))
        if not rest:
            return
        lengths = np.array([len(b) for _, b in rest], dtype=np.int64)
        symbols = self.single[np.frombuffer(b"".join(b for _, b in rest), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(rest)), lengths)
        done = np.zeros(len(rest), dtype=np.int64)
        none = np.int64(1) << 40
        last = len(self.keys) - 1
        while len(symbols):
            # join of adjacent pairs with the ranks
            inside = owner[:-1] == owner[1:]
            key = symbols[:-1] << 20 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), last)
            rank = np.where(inside & (self.keys[at] == key), self.merged[at], none)
            rank = np.append(rank, none)
            # the lowest rank of each piece, its leftmost place
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            ends = np.append(starts[1:], len(symbols))
            best = np.minimum.reduceat(rank, starts)
            where = np.minimum.reduceat(np.where(rank == np.repeat(best, ends - starts), np.arange(len(symbols)), len(symbols)), starts)
            go = best < none
            done[owner[starts[~go]]] = (ends - starts)[~go]
            # the merge
            symbols[where[go]] = best[go]
            keep = np.repeat(go, ends - starts)
            keep[where[go] + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        self.counts.update((p, int(n)) for (p, _), n in zip(rest, done))

    def _long(self, piece: bytes) -> int:
        """Tokens of a long piece: its pairs wait in a heap by rank and place, so the time grows with n log n."""
        rank_of = self.pairs.get
        symbols = [*map(self.single.tolist().__getitem__, piece)]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := rank_of(a << 20 | b)) is not None]
        heapify(heap)
        count = n
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if j >= n or symbols[i] < 0 or rank_of(symbols[i] << 20 | symbols[j]) != rank:
                continue  # one of the two was merged meanwhile
            symbols[i], symbols[j] = rank, -1
            k = after[i] = after[j]
            count -= 1
            if k < n:
                before[k] = i
                if (r := rank_of(rank << 20 | symbols[k])) is not None:
                    heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := rank_of(symbols[h] << 20 | rank)) is not None:
                heappush(heap, (r, h))
        return count

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; null texts have none."""
        split = [self.split(t) if t else [] for t in texts]
        new = set().union(*split) - self.counts.keys()
        if new:
            self.learn(new)
        known = self.counts.__getitem__
        try:
            return [sum(map(known, s)) for s in split]
        except KeyError:  # the memory was cleared
            out = []
            for s in split:
                self.learn(set(s) - self.counts.keys())
                out.append(sum(map(known, s)))
            return out


@lru_cache(maxsize=1)
def _unicode():
    import regex

    return regex.compile(PATTERN)


def shipped(spark: SparkSession, path: str) -> str:
    """The path, with a file that the driver has under it sent along with the job, so that executors need none."""
    if os.path.isfile(path):
        spark.sparkContext.addFile(path)
    return path


@lru_cache(maxsize=4)
def merger(path: str) -> Merger:
    """The merger of a vocabulary, as sent along with the job or, beside Spark, as it is at the path."""
    try:
        sent = SparkFiles.get(os.path.basename(path))
    except Exception:  # no job runs here
        sent = path
    return Merger(sent if os.path.isfile(sent) else path)


def with_tokens(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """The rows with the text column replaced by its number of tokens; nothing is shuffled."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import IntegerType, StructField, StructType

    schema = StructType([f for f in df.schema.fields if f.name != text] + [StructField(name, IntegerType())])
    arrow = to_arrow_schema(schema)
    others = [f.name for f in df.schema.fields if f.name != text]
    vocabulary = shipped(df.sparkSession, vocabulary)

    def run(batches):
        import pyarrow as pa

        m = merger(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                n = m.count(part.column(part.schema.get_field_index(text)).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)).cast(arrow.field(c).type) for c in others), pa.array(n, pa.int32())], schema=arrow)

    return df.mapInArrow(run, schema)


def clean_source(source):
    """Lower case, underscores, no blanks around; null stays null."""
    return F.translate(F.lower(F.trim(source)), "- ", "__")


def chunk_tokens(chunks: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per chunk key: tokens counted and recorded, file type by the path's ending.

    Counting comes before the removal of repeated rows, so texts are not shuffled; of repeated rows the
    latest counts.  Recorded numbers that are null, zero or negative are null.
    """
    rows = chunks.select("repo_id", clean_path(F.col("file_path")).alias("file_path"), "ord", "chunk_id", "indexed_at", F.when(F.col("tokens") > 0, F.col("tokens")).alias("recorded"), F.col("content").alias("text"))
    counted = with_tokens(spread(rows.where("file_path IS NOT NULL")), "text", vocabulary)
    last = counted.groupBy("repo_id", "file_path", "ord").agg(F.max(F.struct("indexed_at", "n_tokens", "recorded", "chunk_id")).alias("x"))
    return last.select("repo_id", "file_path", "ord", "x.chunk_id", extension(F.col("file_path")).alias("file_type"), "x.n_tokens", F.col("x.recorded").alias("recorded_tokens"))


def document_tokens(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document: its tokens, clean source, language and domain; null texts have 0 tokens."""
    from .quality import language

    rows = documents.select("doc_id", clean_source(F.col("source")).alias("source"), language(F.col("lang")).alias("lang"), "domain", "text")
    return with_tokens(spread(rows), "text", vocabulary)


def prompt_tokens(usage: DataFrame) -> DataFrame:
    """(repo_id, chunk_id, n_calls, prompt_tokens): what the ledger says of the prompts that held a chunk.

    Of calls that came twice the latest arrival counts; calls without a chunk or a positive count are left out.
    """
    calls = usage.groupBy("call_id").agg(F.max(F.struct("arrived_at", "repo_id", "chunk_id", "prompt_tokens")).alias("x")).select("x.*")
    return calls.where("chunk_id IS NOT NULL AND repo_id IS NOT NULL AND prompt_tokens > 0").groupBy("repo_id", "chunk_id").agg(F.count("*").alias("n_calls"), F.sum("prompt_tokens").alias("prompt_tokens"))


def text_tokens(chunks: DataFrame, documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per text of either table, with its keys, its slice and its tokens."""
    c = chunk_tokens(chunks, vocabulary).select(
        F.lit("chunks").alias("origin"), "repo_id", "file_path", "ord", F.lit(None).cast("bigint").alias("doc_id"), F.lit("code").alias("source"), "file_type", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("domain"), "n_tokens", "recorded_tokens",
    )
    d = document_tokens(documents, vocabulary).select(
        F.lit("documents").alias("origin"), F.lit(None).cast("int").alias("repo_id"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("int").alias("ord"), "doc_id", "source", F.lit(None).cast("string").alias("file_type"), "lang", "domain", "n_tokens", F.lit(None).cast("int").alias("recorded_tokens"),
    )
    return c.unionByName(d)


def token_budget(chunks: DataFrame, documents: DataFrame, usage: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Texts and tokens per source, file type or language, and domain, with a total per origin (is_total).

    Beside the counted tokens stand those recorded with the chunks and those of the prompts that held them;
    a ledger row whose chunk id several chunks share is spread evenly over these.
    """
    c = chunk_tokens(chunks, vocabulary).alias("c")
    shared = c.groupBy("repo_id", "chunk_id").agg(F.count("*").alias("n_same"))
    p = prompt_tokens(usage).join(shared, ["repo_id", "chunk_id"]).select("repo_id", "chunk_id", (F.col("prompt_tokens") / F.col("n_same")).alias("prompt_tokens"), (F.col("n_calls") / F.col("n_same")).alias("n_calls"))
    code = c.join(p, ["repo_id", "chunk_id"], "left").select(
        F.lit("chunks").alias("origin"), F.lit("code").alias("source"), F.col("file_type").alias("kind"), F.lit(None).cast("string").alias("domain"), "n_tokens", "recorded_tokens", "prompt_tokens", "n_calls"
    )
    d = document_tokens(documents, vocabulary).select(
        F.lit("documents").alias("origin"), "source", F.col("lang").alias("kind"), "domain", "n_tokens", F.lit(None).cast("int").alias("recorded_tokens"), F.lit(None).cast("double").alias("prompt_tokens"), F.lit(None).cast("double").alias("n_calls")
    )
    every = code.unionByName(d).groupBy("origin", "source", "kind", "domain").agg(
        F.count("*").alias("n_texts"), F.sum("n_tokens").alias("n_tokens"), F.count("recorded_tokens").alias("n_recorded"), F.sum("recorded_tokens").alias("recorded_tokens"), F.sum("n_calls").alias("n_calls"), F.sum("prompt_tokens").alias("prompt_tokens")
    )
    sums = [F.sum(x).alias(x) for x in ("n_texts", "n_tokens", "n_recorded", "recorded_tokens", "n_calls", "prompt_tokens")]
    cols = [F.col(x) for x in ("origin", "source", "kind", "domain")]
    return every.groupingSets([cols, [cols[0]]], *cols).agg(*sums, (F.grouping("source") == 1).alias("is_total"))
