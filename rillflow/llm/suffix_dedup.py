"""Suffix-array dedup over bytes, with suffix arrays built column by column over many strings at once.

Every byte is removed that lies in a k-byte string which also starts at another place, in the same or another text.
Strings are judged on the input. repeats.py cuts the texts into strings around minimisers and collapses equal ones; each
bucket of distinct strings is then indexed as one collection: round j inserts the symbol j places from the end of every
string into the collection's Burrows-Wheeler transform and updates the common prefixes, each round being a sequential pass
that writes the next transform and prefix arrays from the last. The transform is held by its inverse (first symbols and
places of rests), which finds a new suffix's place by bisection; places in the text follow from it at the end. There a
string of k bytes repeats where a suffix shares k bytes with a neighbour, or where its string has several places.

The arrays of a round are a bucket's, whose size is bounded, so they are kept in memory rather than in files.

Defined cases: a null text is empty; texts under k bytes lose nothing; a row with a null id is returned whole and its bytes
do not count as other places; rows that repeat an id and text count as places of their own and are judged alike;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, restrict
from .repeats import Bytes, Repeats, covered, tag_of, verdict


#: Bytes of a symbol at most. A string is as many columns' strings, one for each phase, so suffixes start at every byte.
STEP = 8
_BLOCK = 64
_REST = (1 << 32) - 1


def range_minima(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(a[lo:hi]) of each range; none is empty. Long ranges use the minima of blocks."""
    out = np.full(len(lo), np.iinfo(a.dtype).max, a.dtype)

    def plain(x: np.ndarray, at: np.ndarray, l: np.ndarray, h: np.ndarray) -> None:
        keep = h > l
        if keep.any():
            at, l, h = at[keep], l[keep], h[keep]
            ends = np.empty(2 * len(l), np.int64)
            ends[0::2], ends[1::2] = l, h
            out[at] = np.minimum(out[at], np.minimum.reduceat(x, ends)[0::2])

    one = hi - lo == 1
    out[one] = a[lo[one]]
    order = np.flatnonzero(~one)
    order = order[np.argsort(lo[order])]
    l, h = lo[order], hi[order]
    first, last = -(-l // _BLOCK), h // _BLOCK
    far = last > first
    padded = np.append(a, a[:1])
    plain(padded, order[~far], l[~far], h[~far])
    if far.any():
        order, l, h, first, last = order[far], l[far], h[far], first[far], last[far]
        blocks = a[: len(a) // _BLOCK * _BLOCK].reshape(-1, _BLOCK).min(1)
        plain(padded, order, l, first * _BLOCK)
        plain(np.append(blocks, blocks[:1]), order, first, last)
        plain(padded, order, last * _BLOCK, h)
    return out


def insert(text: np.ndarray, lens: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """collection() of strings that stand in text one after the other, each followed by a 0."""
    count, total = len(lens), len(text)
    ends = np.cumsum(lens + 1) - 1
    # The transform by its inverse: in suffix order, a suffix's first symbol and the place of its rest in that order, in
    # one number. These numbers ascend. The buffers serve all rounds; fresh ones cost more than what is done with them.
    every, few = np.arange(total), np.arange(count + 1, dtype=np.int32)
    key, other, rest, moved = (np.empty(total, np.int64) for _ in range(4))
    far = np.empty(total, np.int32)
    lcp, other_lcp = np.zeros(total, np.uint8), np.empty(total, np.uint8)
    key[:count], size = every[:count], count
    head = np.flatnonzero(lens)  # where the newest suffix of each unfinished string stands
    spot = ends[head] - 1  # and the place in text before it
    while len(head):
        new = len(head)
        add = (text[spot] << 32) | head
        by = np.argsort(add)
        add, head, spot = add[by], head[by], spot[by]
        old = key[:size]
        at = np.searchsorted(old, add)
        to = at + every[:new]  # place of each new suffix among all, new ones included
        # The neighbours under the same symbol: a new suffix before it or else an old one; an old one after it.
        left, right = old[at - 1], old[np.minimum(at, size - 1)]
        left[1:] = np.where(at[1:] == at[:-1], add[:-1], left[1:])
        has_left = (left ^ add) >> 32 == 0
        has_right = ((right ^ add) >> 32 == 0) & (at < size)
        has_right[:-1] &= at[1:] > at[:-1]
        lo = np.concatenate([left[has_left] & _REST, head[has_right]]) + 1
        hi = np.concatenate([head[has_left], right[has_right] & _REST]) + 1
        common = np.minimum(range_minima(lcp[:size], lo, hi), cap - 1) + 1
        # Old suffixes move up by the number of new ones before them; the places of rests follow.
        shift = np.repeat(few[: new + 1], np.diff(at, prepend=0, append=size))
        np.take(shift, np.bitwise_and(old, _REST, out=rest[:size]), out=far[:size], mode="clip")
        add += shift[head]
        up = np.add(every[:size], shift, out=rest[:size])
        other[up], other[to] = np.add(old, far[:size], out=moved[:size]), add
        other_lcp[up], other_lcp[to] = lcp[:size], 0
        other_lcp[np.concatenate([to[has_left], to[has_right] + 1])] = common
        key, other, lcp, other_lcp, size = other, key, other_lcp, lcp, size + new
        more = text[spot - 1] > 0  # before the first string stands the last one's end
        head, spot = to[more], spot[more] - 1
    # Back from the ends, which come first in suffix order.
    before, place = other, moved
    before[key[count:] & _REST] = every[count:]
    at, spot, left = every[:count], ends, lens
    while len(at):
        place[at] = spot
        more = left > 0
        at, spot, left = before[at[more]], spot[more] - 1, left[more] - 1
    return place, lcp


def collection(strings: list[np.ndarray], cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in the strings, one after the other, each followed by its end) in suffix order, and the common prefix of each
    suffix with the one before it, up to cap (at most 255). Strings are of unsigned symbols from 1 on; ends order by string."""
    lens = np.array([len(s) for s in strings], np.int64)
    text = np.zeros(int((lens + 1).sum()), np.int64)
    for end, s in zip((np.cumsum(lens + 1) - 1).tolist(), strings, strict=True):
        text[end - len(s) : end] = s
    return insert(text, lens, cap)


def repeated(strings: list[bytes], k: int) -> list[np.ndarray]:
    """For each string, whether the k bytes from each place on also stand elsewhere in the collection."""
    step = math.gcd(k, STEP)
    lens = np.array([len(s) for s in strings], np.int64)
    starts = np.cumsum(lens) - lens
    code = np.frombuffer(b"".join(strings) + bytes(step - 1), np.uint8).astype(np.uint64)
    for width in (w for w in (1, 2, 4) if w < step):
        code = (code[:-width] << np.uint64(8 * width)) | code[width:]
    _, code = np.unique(code, return_inverse=True)
    # One column's string after the other: where in the bytes each of its symbols begins.
    sizes = (np.maximum(0, lens[:, None] - np.arange(step)) // step).ravel()
    ends = np.cumsum(sizes + 1) - 1
    byte = np.repeat((starts[:, None] + np.arange(step)).ravel() - step * (ends - sizes), sizes + 1) + step * np.arange(int((sizes + 1).sum()))
    byte[ends] = 0
    text = code[byte] + 1 if len(code) else np.zeros(len(byte), np.int64)
    text[ends] = 0
    place, lcp = insert(text, sizes, k // step)
    hit = lcp >= k // step
    hit[:-1] |= lcp[1:] >= k // step
    flag = np.zeros(int(lens.sum()), bool)
    flag[byte[place[hit]]] = True
    return [flag[a : a + max(0, n - k + 1)] for a, n in zip(starts.tolist(), lens.tolist(), strict=True)]


def judge(k: int) -> Callable[[pa.Table], pa.Table]:
    def run(g: pa.Table) -> pa.Table:
        many = [x | (p > 1) for x, p in zip(repeated(g["s"].to_pylist(), k), g["places"].to_pylist(), strict=True)]
        return pa.Table.from_arrays([g["mh"], g["dg"], *verdict(None, many)], names=["mh", "dg", "lo", "firsts", "any", "many"])

    return run


def windows(runs: pa.StructArray) -> np.ndarray:
    """Where the removed windows of the runs that have a verdict start."""
    many = runs.field("many").cast(pa.large_binary())
    if many.buffers()[2] is None:
        return np.zeros(0, np.int64)
    off = np.frombuffer(many.buffers()[1], np.int64, len(many) + 1 + many.offset)[many.offset :]
    bit = np.flatnonzero(np.unpackbits(np.frombuffer(many.buffers()[2], np.uint8)[off[0] : off[-1]]))
    run = np.searchsorted(off, (bit >> 3) + off[0], "right") - 1
    at = runs.field("start").to_numpy(zero_copy_only=False)[run] + bit - 8 * (off[run] - off[0])
    return at[many.is_valid().to_numpy(zero_copy_only=False)[run]]


_OUT = pa.schema([("doc_id", pa.int64()), ("tag", pa.int32()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _remove(k: int, texts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in _OUT]
            for doc, tag, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                raw = (text.as_py() or "").encode()
                if tag_of(raw) != tag:
                    continue
                gone = covered(runs.values, len(raw), k, windows(runs.values))
                spans = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]])))
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                for c, v in zip(cols, (doc, tag, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if texts else None), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT, strict=True)], schema=_OUT)

    return run


def suffix_dedup(docs: DataFrame, k: int = 200, m: int = 64, texts: bool = False, id_col: str = "doc_id", text_col: str = "text", ws: Workspace | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; texts: with kept bytes, null where nothing went.

    k is at most 255; m: bytes of a minimiser, fewer than k.
    """
    if not 1 < k <= 255:
        raise ValueError("k is 2 to 255")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    r = Repeats(d, Bytes, k, m, "suffix", 1500, ws)
    runs = r.verdicts(judge, across_ids=False).where("coalesce(any, places > 1)")
    per_doc = r.ws.put(runs.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "n", "many")).alias("runs")), "per_doc")
    hit = restrict(d.where("doc_id is not null"), "doc_id", per_doc, "doc_id").join(per_doc, "doc_id").select("doc_id", "tag", "text", "runs")
    out = hit.mapInArrow(_remove(k, texts), "doc_id long, tag int, n_removed long, n_spans long, kept_sha256 string, kept binary").dropDuplicates(["doc_id", "tag"])
    base = r.base.select("doc_id", F.col("size").alias("n_bytes"), "sha", "tag").join(out, ["doc_id", "tag"], "left")
    cols = ["doc_id", "n_bytes", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_removed", "n_spans")), F.coalesce("kept_sha256", "sha").alias("kept_sha256")]
    return base.select(*cols, *(["kept"] if texts else []))
