"""Mixture-controlled packing: deficit round-robin over source queues into fixed windows of tokens.

Each source is a queue of its documents' tokens. In round r of R, source s may send its quantum T_s / R (T_s: its tokens);
what is less than a token is carried as its deficit, so after r rounds it has sent floor(r * T_s / R), exactly, in whichever
task the round is computed: deficits pass over windows and partitions by arithmetic, with no state to hand on. Rounds
follow each other in one stream of tokens, which is cut into sequences; only the last sequence is short. With targets, the
quanta follow the targets for as long as all queues have tokens; then a phase ends and the rest share by their targets.

A document is its ids and the end id; documents are cut where a quantum or a sequence ends. Token ids are written once to
the shared folder, with each chunk's offsets in its queues; prefix sums of the chunks' totals place them, so no queue is
ever gathered in a task, whatever its share of the rows. With more sources than the driver should hold, totals and rounds
are tables as well, with the same pieces as result.

Defined cases: a null text is empty (one piece with the end id); a null source is a queue of its own; repeated rows are
packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace
from .tokens import Tokenizer

#: Texts tokenised as one chunk: by rows and by characters.
CHUNK_ROWS, CHUNK_CHARS = 4096, 8 << 20
_NO_SOURCE = "\x00"


def _tokenise(tokenizer: Tokenizer, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, chunk = TaskContext.get().partitionId(), 0
        sent: dict[str, int] = {}
        rows = chars = 0
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            size = 0
            for doc, text, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if rows >= CHUNK_ROWS or chars >= CHUNK_CHARS:
                    chunk, rows, chars, sent = chunk + 1, 0, 0, {}
                ids = np.append(tokenizer.encode(text or ""), np.uint32(end_id)).astype("<u4")
                source = _NO_SOURCE if source is None else source
                at = sent.get(source, 0)
                sent[source] = at + len(ids)
                rows, chars, size = rows + 1, chars + len(text or ""), size + 4 * len(ids)
                narrow = ids.astype("<u2") if tokenizer.size <= 1 << 16 else ids
                for col, x in zip(out, (doc, source, (part << 32) + chunk, at, len(ids), narrow.tobytes()), strict=True):
                    col.append(x)
                if size > 8 << 20:
                    yield _chunk_batch(out)
                    out, size = [[], [], [], [], [], []], 0
            if out[0]:
                yield _chunk_batch(out)

    return run


_TOKENS = "doc_id long, source string, chunk long, at long, n long, ids binary"
_TOKENS_ARROW = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("chunk", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
_PIECES_ARROW = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in _PIECES.split(", ")])


def _chunk_batch(cols: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _TOKENS_ARROW, strict=True)], schema=_TOKENS_ARROW)


def phases(totals: dict[str, int], targets: dict[str, float] | None) -> list[dict[str, int]]:
    """Tokens that each source sends in each phase: within one, in constant proportions; a phase ends when a queue does."""
    left, out = dict(totals), []
    if targets is None:
        return [left]
    weight = {s: max(0.0, float(targets.get(s, 0.0))) for s in left}
    while any(left.values()):
        live = {s: w for s, w in weight.items() if left[s] and w > 0}
        if not live:
            out.append({s: n for s, n in left.items() if n})
            break
        rounds = min(left[s] / w for s, w in live.items())
        sent = {s: min(left[s], round(rounds * w)) for s, w in live.items()}
        ends = min(live, key=lambda s: left[s] / live[s])
        sent[ends] = left[ends]
        out.append({s: n for s, n in sent.items() if n})
        left = {s: n - sent.get(s, 0) for s, n in left.items()}
    return out


class Schedule:
    """Where the tokens of a queue lie in the stream: exact for every round, from the queues' totals alone."""

    def __init__(self, plan: list[dict[str, int]], window: int):
        self.sources = sorted({s for p in plan for s in p})
        self.parts, base, before = [], 0, dict.fromkeys(self.sources, 0)
        for p in plan:
            total = sum(p.values())
            self.parts.append((p, max(1, -(-total // window)), base, dict(before)))
            base += total
            for s, n in p.items():
                before[s] += n

    def pieces(self, source: str, start: int, length: int) -> list[tuple[int, int, int]]:
        """(offset in the range, stream position, length) of the parts of [start, start + length) of a queue."""
        out, end = [], start + length
        for p, rounds, base, before in self.parts:
            n, first = p.get(source, 0), before[source]
            a, b = max(start, first), min(end, first + n)
            if a >= b:
                continue
            at = a - first
            r = at * rounds // n
            while (r + 1) * n // rounds <= at:
                r += 1
            while a < b:
                lo, hi = r * n // rounds, (r + 1) * n // rounds
                take = min(b - first, hi) - at
                if take > 0:
                    ahead = 0
                    for s, m in p.items():
                        ahead += (r * m // rounds) if s >= source else ((r + 1) * m // rounds)
                    out.append((a - start, base + ahead + at - lo, take))
                    a, at = a + take, at + take
                r += 1
        return out


def _cut(plan: list[dict[str, int]], window: int, length: int, wide: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule = Schedule(plan, window)
        for batch in batches:
            out: list[list] = [[] for _ in _PIECES_ARROW]
            for doc, source, at, n, raw in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                ids = np.frombuffer(raw, "<u4" if wide else "<u2").astype("<u4")
                for lo, g, m in schedule.pieces(source, at, n):
                    while m:
                        k = min(m, length - g % length)
                        row = (doc, lo, k, zlib.crc32(ids[lo : lo + k].tobytes()), n, g // length, g % length, None if source == _NO_SOURCE else source)
                        for col, x in zip(out, row, strict=True):
                            col.append(x)
                        lo, g, m = lo + k, g + k, m - k
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PIECES_ARROW, strict=True)], schema=_PIECES_ARROW)

    return run


def pack(
    docs: DataFrame,
    tokenizer: Tokenizer,
    length: int = 1024,
    window_sequences: int = 64,
    targets: dict[str, float] | None = None,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_queues: int = 1024,
    broadcast_chunks: int = 100_000,
    ws: Workspace | None = None,
) -> DataFrame:
    """Pieces of documents in sequences: see _PIECES. targets: weight of each source; by default its share of all tokens.

    Every source is a queue of its own. Up to max_queues sources the driver holds their totals; beyond, they are a table
    joined by shuffle, with the same pieces as result (targets name their sources, so they always go by the driver). Chunk
    offsets are broadcast up to broadcast_chunks rows and joined by shuffle beyond.
    """
    spark = docs.sparkSession
    ws = ws or Workspace(spark, "packing")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"))
    tokens = ws.put(rows.mapInArrow(_tokenise(tokenizer, end_id), _TOKENS), "tokens")
    chunks = tokens.groupBy("source", "chunk").agg(F.sum("n").alias("sent"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    places = ws.put(chunks.select("source", "chunk", F.coalesce(F.sum("sent").over(before), F.lit(0)).alias("before"), "sent"), "places")
    sums = places.groupBy("source").agg(F.sum("sent").alias("total"))
    wide = targets is None and places.select("source").distinct().limit(max_queues + 1).count() > max_queues
    places = places.drop("sent")
    if places.count() <= broadcast_chunks:
        places = F.broadcast(places)
    placed = tokens.join(places, ["source", "chunk"]).select("doc_id", "source", (F.col("at") + F.col("before")).alias("at"), "n", "ids")
    if wide:
        return _pack_wide(placed, sums, window_sequences * length, length, tokenizer.size > 1 << 16, ws)
    totals = {r.source: r.total for r in sums.collect()}  # at most max_queues rows, or as many as targets name
    return placed.mapInArrow(_cut(phases(totals, targets), window_sequences * length, length, tokenizer.size > 1 << 16), _PIECES)


#: Rounds whose sums are added up together.
ROUNDS = 4096


def _quanta(rounds: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(source, bucket, round, tokens) of the rounds in which a source sends a token or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, total, bucket in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for lo in range(0, rounds, 1 << 16):
                    r = range(lo, min(rounds, lo + (1 << 16)) + 1)
                    # Rounds in which it sends: that of each token, or all of them.
                    if total < rounds:
                        first, last = r[0] * total // rounds, r[-1] * total // rounds
                        at = [-(-(j + 1) * rounds // total) - 1 for j in range(first, last)]
                        q = [1] * len(at)
                    else:
                        at = list(r[:-1])
                        q = [(x + 1) * total // rounds - x * total // rounds for x in at]
                    if at:
                        m = len(at)
                        yield pa.RecordBatch.from_arrays([pa.array([source] * m, pa.string()), pa.array([bucket] * m, pa.int32()), pa.array(at, pa.int64()), pa.array(q, pa.int64())], names=["source", "bucket", "r", "q"])

    return run


def _split(rounds: int, wide: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents cut where a quantum ends: the round, the place in its quantum, and the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 4 if wide else 2
        for batch in batches:
            out: list[list] = [[] for _ in _SPLIT_ARROW]
            for doc, source, at, n, raw, total in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                lo = 0
                while lo < n:
                    # The token at place x of a queue is sent in the round r with floor(r T / R) <= x < floor((r + 1) T / R).
                    r = -(-(at + lo + 1) * rounds // total) - 1
                    first, end = r * total // rounds, (r + 1) * total // rounds
                    k = min(n - lo, end - at - lo)
                    for col, x in zip(out, (doc, source, r, at + lo - first, lo, k, n, raw[lo * size : (lo + k) * size]), strict=True):
                        col.append(x)
                    lo += k
                if len(out[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SPLIT_ARROW, strict=True)], schema=_SPLIT_ARROW)
                    out = [[] for _ in _SPLIT_ARROW]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SPLIT_ARROW, strict=True)], schema=_SPLIT_ARROW)

    return run


_SPLIT = "doc_id long, source string, r long, inside long, start long, k long, n long, ids binary"
_SPLIT_ARROW = pa.schema([(x.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]]) for x in _SPLIT.split(", ")])


def _sequences(length: int, wide: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _PIECES_ARROW]
            for doc, source, g, start, n, raw in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                ids, at = np.frombuffer(raw, "<u4" if wide else "<u2").astype("<u4"), 0
                while at < len(ids):
                    k = min(len(ids) - at, length - g % length)
                    row = (doc, start + at, k, zlib.crc32(ids[at : at + k].tobytes()), n, g // length, g % length, None if source == _NO_SOURCE else source)
                    for col, x in zip(out, row, strict=True):
                        col.append(x)
                    at, g = at + k, g + k
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PIECES_ARROW, strict=True)], schema=_PIECES_ARROW)

    return run


def _pack_wide(placed: DataFrame, sums: DataFrame, window: int, length: int, wide: bool, ws: Workspace) -> DataFrame:
    """The pieces of Schedule where no task holds all totals. A quantum's place is the sum of the rounds before its own and of
    the smaller sources' quanta in it; sums go by blocks of rounds and by ranges of sources, so no task adds up a whole round."""
    # A range sort numbers its partitions in the order of the sources.
    sums = ws.put(sums.orderBy("source").withColumn("bucket", F.spark_partition_id()), "sums")
    rounds = max(1, -(-sums.agg(F.sum("total")).first()[0] // window))
    quanta = ws.put(sums.select("source", "total", "bucket").mapInArrow(_quanta(rounds), "source string, bucket int, r long, q long"), "quanta")

    def earlier(by, order, what):
        w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(what).over(w), F.lit(0))

    ranges = quanta.groupBy("r", "bucket").agg(F.sum("q").alias("s"))
    each = ranges.groupBy("r").agg(F.sum("s").alias("s")).withColumn("block", F.expr(f"r div {ROUNDS}"))
    blocks = each.groupBy("block").agg(F.sum("s").alias("s")).select("block", earlier(F.lit(0), "block", "s").alias("b0"))  # a row for ROUNDS rounds
    each = each.select("r", "block", earlier("block", "r", "s").alias("b1")).join(blocks, "block").select("r", (F.col("b0") + F.col("b1")).alias("base"))
    ranges = ranges.select("r", "bucket", earlier("r", "bucket", "s").alias("ahead")).join(each, "r").select("r", "bucket", (F.col("base") + F.col("ahead")).alias("base"))
    starts = quanta.select("source", "r", "bucket", earlier(["r", "bucket"], "source", "q").alias("ahead")).join(ranges, ["r", "bucket"]).select("source", "r", (F.col("base") + F.col("ahead")).alias("first"))
    starts = ws.put(starts, "starts")
    parts = placed.join(sums.select("source", "total"), "source").select("doc_id", "source", "at", "n", "ids", "total").mapInArrow(_split(rounds, wide), _SPLIT)
    parts = parts.join(starts, ["source", "r"]).select("doc_id", "source", (F.col("first") + F.col("inside")).alias("g"), "start", "n", "ids")
    return parts.mapInArrow(_sequences(length, wide), _PIECES)


def mixture(pieces: DataFrame, window: int) -> DataFrame:
    """Tokens of each source in each window of that many sequences, for reports and tests."""
    return pieces.groupBy(F.expr(f"sequence_id div {int(window)}").alias("window"), "source").agg(F.sum("length").alias("tokens"))
