"""Oversized texts cut into pieces under a limit, at natural boundaries, with an overlap between neighbours.

A hierarchy of separators is tried from the coarsest: sections, paragraphs, lines and sentences, words,
then single units.  A fragment that is still too large is cut by the next finer one; fragments are then
packed greedily, each piece beginning with the last units of the one before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import distinct_chunks, map_rows

#: A unit: a longest run of these characters, or any other single one but white space.
UNIT = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]"
_UNIT = re.compile(UNIT)
_SECTION = re.compile(r"(?:async )?def |class |@|function |export |public |private |#{1,6} |\[|---|=== |interface |enum |const \w+ = (?:async )?\(")
CHARACTER, WORD, SENTENCE, LINE, PARAGRAPH, SECTION = range(6)


def boundary(text: str, end: int, start: int) -> int:
    """The level of the boundary between a unit that ends at `end` and the next that begins at `start`."""
    gap = text[end:start]
    if not gap:
        return CHARACTER
    lines = gap.count("\n")
    if lines:
        if lines > 1:
            return SECTION if gap[-1] == "\n" and _SECTION.match(text, start) else PARAGRAPH
        return LINE
    return SENTENCE if text[end - 1] in ".!?;" else WORD


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, units) of each piece; piece n+1 repeats the last `overlap` units of piece n.

    What follows the overlaps, joined, is the text.  One piece if the text is within the limit.  An overlap
    of the limit or more would leave no room for anything new: it is limit - 1 then.
    """
    spans = [m.span() for m in _UNIT.finditer(text)]
    n = len(spans)
    if n <= limit:
        return [(0, len(text), n)]
    overlap = max(0, min(overlap or 0, limit - 1))
    room = limit - overlap
    level = [SECTION, *(boundary(text, spans[i - 1][1], spans[i][0]) for i in range(1, n))]

    def fragments(lo: int, hi: int, at: int) -> Iterator[tuple[int, int]]:
        if hi - lo <= room or at < CHARACTER:
            yield lo, hi
            return
        begin = lo
        for i in range(lo + 1, hi + 1):
            if i == hi or level[i] >= at:
                if i - begin > room:
                    if at > CHARACTER:
                        yield from fragments(begin, i, at - 1)
                    else:
                        for j in range(begin, i, room):
                            yield j, min(j + room, i)
                else:
                    yield begin, i
                begin = i

    out: list[tuple[int, int]] = []  # units of the pieces, without overlap
    for lo, hi in fragments(0, n, SECTION):
        # the first piece has no overlap before it
        if out and hi - out[-1][0] <= (limit if out[-1][0] == 0 else room):
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    result = []
    for k, (lo, hi) in enumerate(out):
        first = max(0, lo - overlap) if k else 0
        start = spans[first][0] if k else 0
        end = spans[hi][0] if hi < n else len(text)
        result.append((start, end, hi - first))
    return result


def _each(repo_id, path, ord_, text, start_line, limit, overlap) -> Iterator[tuple]:
    cut = pieces(text, limit, overlap or 0)
    for k, (a, b, n) in enumerate(cut):
        piece = text[a:b]
        first = None if start_line is None else start_line + text.count("\n", 0, a)
        yield repo_id, path, ord_, k + 1, len(cut), n, a, b, first, None if first is None else first + piece.rstrip("\r\n").count("\n"), piece


def split_oversized(chunks: DataFrame, limits: DataFrame, purpose: str = "chunk_split") -> DataFrame:
    """The pieces of every chunk whose content holds more units than the purpose allows.

    Of repeated rows the latest counts, the same as in files(), whether or not an earlier one was larger; a null
    content holds none; a null overlap is 0; without a limit for the purpose there are no rows.  Contents
    within the limit are counted where they are read and are not shuffled.
    """
    limit = limits.where(F.col("purpose") == purpose).agg(F.min("max_tokens").alias("limit"), F.max("overlap_tokens").alias("overlap"))
    large = (F.length("content") > F.col("limit")) & (F.regexp_count("content", F.lit(UNIT)) > F.col("limit"))
    counted = chunks.select("repo_id", "file_path", "ord", "indexed_at", "start_line", "content", F.xxhash64("content").alias("version")).join(F.broadcast(limit))
    rows = distinct_chunks(counted.withColumn("content", F.when(large, F.col("content"))), "content", "start_line", "limit", "overlap").where("content IS NOT NULL")
    rows = rows.select("repo_id", "file_path", "ord", "content", "start_line", F.col("limit").cast("int"), F.col("overlap").cast("int"))
    return map_rows(rows, _each, "repo_id INT, file_path STRING, ord INT, piece INT, n_pieces INT, n_units INT, start INT, end INT, start_line INT, end_line INT, content STRING")


def oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """(repo_id, file_path, ord) of the chunks that had to be split."""
    return split_oversized(chunks, limits).where("piece = 1").select("repo_id", "file_path", "ord")
