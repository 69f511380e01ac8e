"""Token-bounded chunks from blocks, spans, budgets of context, and renderings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Default limits in tokens and chunks.
LEAST, SOFT, HARD, MOST = 100, 750, 2000, 200


def merge_small(sizes: list[int], least: int = LEAST, hard: int = HARD, most: int = MOST) -> list[tuple[int, int]]:
    """Runs (first, last) of consecutive chunks after small ones were merged.

    A chunk under ``least`` joins a neighbour: the first its right, the last its left, others the smaller one, unless
    the sum exceeds ``hard``; repeated until nothing changes.  While there are more than ``most``, the smallest pairs join.
    """
    runs = [(i, i) for i in range(len(sizes))]
    load = list(sizes)
    moved = True
    while moved and len(load) > 1:
        moved = False
        for i, n in enumerate(load):
            if n >= least:
                continue
            options = [j for j in (i - 1, i + 1) if 0 <= j < len(load) and load[j] + n <= hard]
            if not options:
                continue
            j = min(options, key=lambda j: (load[j], j))
            a, b = min(i, j), max(i, j)
            load[a : b + 1] = [load[a] + load[b]]
            runs[a : b + 1] = [(runs[a][0], runs[b][1])]
            moved = True
            break
    while len(load) > most:
        i = min(range(len(load) - 1), key=lambda i: (load[i] + load[i + 1], i))
        load[i : i + 2] = [load[i] + load[i + 1]]
        runs[i : i + 2] = [(runs[i][0], runs[i + 1][1])]
    return runs


def bounded_chunks(blocks: list[dict], soft: int = SOFT, hard: int = HARD, least: int = LEAST, most: int = MOST) -> list[tuple[int, int, int]]:
    """(start line, end line, tokens) of chunks over a file's blocks.

    A block within the soft limit stays whole; a larger one is entered, its header going with its first child.
    Consecutive blocks are gathered up to the soft limit.  A leaf over the hard limit is its own chunk.
    """
    children: dict[int, list[dict]] = {}
    for b in blocks:
        children.setdefault(b["parent"], []).append(b)
    pieces: list[tuple[int, int, int]] = []

    def visit(b: dict):
        kids = children.get(b["block"], [])
        if b["tokens"] <= soft or not kids:
            pieces.append((b["start_line"], b["end_line"], b["tokens"]))
            return
        first = kids[0]["start_line"]
        if first > b["start_line"]:
            share = max(1, b["tokens"] - sum(k["tokens"] for k in kids))
            pieces.append((b["start_line"], first - 1, share))
        for k in kids:
            visit(k)

    for b in children.get(0, []) or [b for b in blocks if b["block"] == 0]:
        visit(b)
    gathered: list[tuple[int, int, int]] = []
    for s, e, n in pieces:
        if gathered and gathered[-1][2] + n <= soft:
            gathered[-1] = (gathered[-1][0], max(e, gathered[-1][1]), gathered[-1][2] + n)
        else:
            gathered.append((s, e, n))
    return [(gathered[a][0], max(x[1] for x in gathered[a : b + 1]), sum(x[2] for x in gathered[a : b + 1])) for a, b in merge_small([x[2] for x in gathered], least, hard, most)]


def chunked(blocks: DataFrame, soft: int = SOFT, hard: int = HARD, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Chunks of each file from its blocks(repo_id, file_path, block, parent, start_line, end_line, tokens); a fold per file."""

    def run(frame):
        import pandas as pd

        rows = bounded_chunks(frame.sort_values("block").to_dict("records"), soft, hard, least, most)
        return pd.DataFrame([(frame["repo_id"].iat[0], frame["file_path"].iat[0], i, s, e, n) for i, (s, e, n) in enumerate(rows, 1)], columns=["repo_id", "file_path", "ord", "start_line", "end_line", "tokens"])

    cols = blocks.select("repo_id", "file_path", "block", F.coalesce("parent", F.lit(-1)).alias("parent"), "start_line", "end_line", "tokens")
    return cols.groupBy("repo_id", "file_path").applyInPandas(run, "repo_id INT, file_path STRING, ord INT, start_line INT, end_line INT, tokens INT")


def spans(blocks: DataFrame, limit: int = 500) -> DataFrame:
    """Each block with its span (B9, B10): a function, class or import run is a span of its own, other statements of the
    module gather into spans of at most ``limit`` tokens; a span is named after its first block, repeats are numbered."""

    def run(frame):
        frame = frame.sort_values("block")
        out, counts, current, load, kind = [], {}, None, 0, None
        for _, b in frame.iterrows():
            own = b["type"] in ("function", "class", "constructor")
            new = current is None or own or kind != ("own" if own else b["type"] == "import") or load + b["tokens"] > limit
            if new:
                base = b["path"] if own else "imports" if b["type"] == "import" else "module"
                counts[base] = counts.get(base, 0) + 1
                current = base if counts[base] == 1 else f"{base}:{counts[base]}"
                load = 0
            load += b["tokens"]
            kind = "own" if own else b["type"] == "import"
            out.append((b["repo_id"], b["file_path"], b["block"], current))
        import pandas as pd

        return pd.DataFrame(out, columns=["repo_id", "file_path", "block", "span_id"])

    return blocks.groupBy("repo_id", "file_path").applyInPandas(run, "repo_id INT, file_path STRING, block INT, span_id STRING")


def expanded_context(context: DataFrame, related: DataFrame, spans: DataFrame, limit: int, group: list[str]) -> DataFrame:
    """Spans that those of a context draw in, until one does not fit.

    context(group.., span_id, tokens), related(group.., span_id, related), spans(group.., span_id, tokens). Spans of the
    context are taken from the largest down and their related ones in order; one that is there already is passed over.
    A span fits if the greater of its tokens and those of the span that draws it stays, with all there is, within the
    limit; with the first that does not, the group ends. A context over the limit draws in nothing.
    """
    size = context.groupBy(*group).agg(F.sum("tokens").alias("__size")).where(F.col("__size") <= limit)
    x = context.select(*group, F.col("span_id").alias("__via"), F.col("tokens").alias("__of")).join(related.select(*group, F.col("span_id").alias("__via"), F.col("related").alias("span_id")), [*group, "__via"])
    x = x.join(context.select(*group, "span_id"), [*group, "span_id"], "left_anti").join(spans.select(*group, "span_id", "tokens"), [*group, "span_id"]).join(size, group)
    x = x.groupBy(*group, "span_id", "tokens", "__size").agg(F.min(F.struct((-F.col("__of")).alias("o"), F.col("__via"))).alias("__by"))
    so_far = Window.partitionBy(*group).orderBy("__by.o", "__by.__via", "span_id")
    x = x.withColumn("__added", F.coalesce(F.sum("tokens").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    fits = F.greatest(F.col("tokens"), -F.col("__by.o")) + F.col("__size") + F.col("__added") <= limit
    return x.withColumn("__fits", F.every(fits).over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("__fits").select(*group, "span_id", "tokens")


def concatenated(chunks: DataFrame, group: list[str], order: list[str], text: str = "content", separator: str = "\n", size: int = 1000) -> DataFrame:
    """Texts of a group joined in order, in parts of at most ``size`` rows (N19, J14, J17, A26): group.., part, n, text.

    The parts of a group, in order of part and joined by the separator, are its text; so a group of any size is spread
    over tasks, and no text is longer than its part. Null texts are empty.
    """
    from .ordered import numbered

    rows = chunks.select(*group, *order, F.coalesce(text, F.lit("")).alias("t"))
    x = numbered(rows, [F.col(c) for c in (*group, *order)], "__n").withColumn("part", F.floor(F.col("__n") / size))
    x = x.groupBy(*group, "part").agg(F.sort_array(F.collect_list(F.struct("__n", "t"))).alias("x"))
    return x.select(*group, "part", F.size("x").alias("n"), F.array_join(F.transform("x", lambda r: r["t"]), separator).alias("text"))


def valid_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with lines and spans, CRLF made LF."""
    return chunks.where("start_line IS NOT NULL AND end_line IS NOT NULL AND size(span_ids) > 0").withColumn("content", F.replace("content", F.lit("\r\n"), F.lit("\n")))


def generated_over_limit(chunks: DataFrame, limit: int = HARD) -> DataFrame:
    """Files over the limit whose first line is a comment that says 'generated' (C12)."""
    w = Window.partitionBy("repo_id", "file_path").orderBy("ord")
    first = chunks.select("repo_id", "file_path", F.first("content").over(w).alias("first"), "tokens").groupBy("repo_id", "file_path").agg(F.min("first").alias("first"), F.sum("tokens").alias("tokens"))
    return first.where((F.col("tokens") > limit) & F.lower(F.substring_index("first", "\n", 1)).rlike(r"^\s*(#|//|/\*).*generated")).select("repo_id", "file_path", "tokens")
