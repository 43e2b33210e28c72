"""Windows of k symbols that repeat, by minimiser partitioning; used by the word and the byte form of substring dedup.

Consecutive windows that share the occurrence of their minimiser travel as one run. The first pass over the texts writes,
for each text, its runs: the minimiser, a digest of the run's symbols, its place. Equal windows have equal minimisers, so
only minimisers with more than one run matter, and runs with equal digests are one string with many places, collapsed
before anything else is looked at: a passage that a third of all texts share is one string. Where all runs of a minimiser
are one string, its windows repeat as a whole. Where they are several, the strings are cut from the texts, packed, sent to
buckets and judged there by the operator; strings of a minimiser with very many of them go as single windows, which are
combined before the shuffle.

Rows that repeat an id are told apart by 32 bits of their text's digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, restrict
from .kernels import minimiser_runs, slices, word_digests, word_spans

#: Strings of one minimiser beyond which they are judged window by window.
HOT_STRINGS = 4000
#: Bytes of texts taken at a time: their arrays of 64-bit values stay in the cache.
SLICE = 1 << 17
#: Tasks that buckets are dealt to at most.
MOST_TASKS = 20_000

_RUN = pa.struct([("mh", pa.int64()), ("dg", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
_BASE = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("sha", pa.string()), ("tag", pa.int32()), ("runs", pa.list_(_RUN))])
BASE = "doc_id long, size long, sha string, tag int, runs array<struct<mh:long,dg:long,start:int,n:int>>"


def tag_of(raw: bytes) -> int:
    return int.from_bytes(hashlib.sha256(raw).digest()[:4], "big", signed=True)


class Words:
    """Symbols are words without ASCII white space; strings are words joined by one space."""

    joint = b" "

    @staticmethod
    def symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        st, en, woff = word_spans(data, off)
        return word_digests(data, st, en), woff

    @staticmethod
    def split(text: bytes) -> list[bytes]:
        return text.split()  # bytes.split() cuts at ASCII white space, \x09-\x0D and space

    @staticmethod
    def join(parts: list[bytes]) -> bytes:
        return b" ".join(parts)


class Bytes:
    """Symbols are bytes of the UTF-8 form."""

    joint = b""

    @staticmethod
    def symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        from .kernels import BYTE

        return BYTE[data], off

    @staticmethod
    def split(text: bytes) -> bytes:
        return text

    @staticmethod
    def join(parts: bytes) -> bytes:
        return bytes(parts)


def _runs(unit, k: int, m: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in slices(batch, size=SLICE):
                values, so = unit.symbols(data, off)
                text, start, count, mh, dg, _ = minimiser_runs(values, so, k, m)
                at = np.searchsorted(text, np.arange(len(off)))
                runs = pa.StructArray.from_arrays([pa.array(mh.view(np.int64)), pa.array(dg.view(np.int64)), pa.array(start, pa.int32()), pa.array(count, pa.int32())], fields=list(_RUN))
                raw = data.tobytes()
                sha = [hashlib.sha256(unit.join(unit.split(raw[a:b]))).digest() for a, b in zip(off[:-1], off[1:], strict=True)]
                tag = pa.array([int.from_bytes(x[:4], "big", signed=True) for x in sha], pa.int32())
                ids = batch.column(0).slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(so), pa.int64()), pa.array([x.hex() for x in sha], pa.string()), tag, pa.ListArray.from_arrays(pa.array(at, pa.int32()), runs)], schema=_BASE)

    return run


_CUT = pa.schema([("mh", pa.int64()), ("dg", pa.int64()), ("first", pa.int64()), ("places", pa.int64()), ("n", pa.int32()), ("s", pa.binary())])


def _cut(unit, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The packed string of each wanted run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in _CUT]
            for text, tag, want in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), strict=True):
                parts = unit.split((text.as_py() or "").encode())
                if tag_of(unit.join(parts)) != tag:
                    continue
                for w in want.as_py():
                    s = unit.join(parts[w["start"] : w["start"] + w["n"] + k - 1])
                    for c, v in zip(cols, (w["mh"], w["dg"], w["first"], w["places"], w["n"], s), strict=True):
                        c.append(v)
                if len(cols[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _CUT, strict=True)], schema=_CUT)
                    cols = [[] for _ in _CUT]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _CUT, strict=True)], schema=_CUT)

    return run


_WIN = pa.schema([("mh", pa.int64()), ("dg", pa.int64()), ("i", pa.int32()), ("first", pa.int64()), ("places", pa.int64()), ("w", pa.binary())])


def _windows(unit, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Single windows of strings, each as a 128-bit digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(0, batch.num_rows, 2000):
                cols: list[list] = [[] for _ in _WIN]
                for mh, dg, first, places, n, s in zip(*(c.to_pylist() for c in batch.slice(j, 2000).columns), strict=True):
                    parts = unit.split(s)
                    for i in range(n):
                        w = hashlib.blake2b(unit.join(parts[i : i + k]), digest_size=16).digest()
                        for c, v in zip(cols, (mh, dg, i, first, places, w), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _WIN, strict=True)], schema=_WIN)

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        firsts = [np.array(x, "<i8") for x in batch.column(2).to_pylist()]
        many = [np.array(x, bool) for x in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *verdict(firsts, many)], names=["mh", "dg", "lo", "firsts", "any", "many"])


def verdict(firsts: list[np.ndarray] | None, many: list[np.ndarray]) -> list[pa.Array]:
    """Columns lo, firsts, any, many of JUDGED from arrays by window."""
    if firsts is None:
        lo, packed = pa.nulls(len(many), pa.int64()), pa.nulls(len(many), pa.binary())
    else:
        lo, packed = pa.array([int(x.min()) for x in firsts], pa.int64()), pa.array([x.astype("<i8").tobytes() for x in firsts], pa.binary())
    return [lo, packed, pa.array([bool(x.any()) for x in many], pa.bool_()), pa.array([np.packbits(x).tobytes() for x in many], pa.binary())]


#: A string's windows: the smallest id at which each starts (packed, and the least of them), and whether it starts at two
#: places or more (packed bits, and whether any does).
JUDGED = "mh long, dg long, lo long, firsts binary, any boolean, many binary"


def covered(runs: pa.StructArray, size: int, k: int, at: np.ndarray) -> np.ndarray:
    """Which of size symbols lie in a removed window. runs: (start, n, ...); those without a verdict are removed whole, at
    says where the removed windows of the others start."""
    start, n = runs.field("start").to_numpy(zero_copy_only=False), runs.field("n").to_numpy(zero_copy_only=False)
    whole = runs.field("many").is_null().to_numpy(zero_copy_only=False)
    lo = np.concatenate([start[whole].astype(np.int64), at])
    hi = np.concatenate([(start[whole] + n[whole] - 1 + k).astype(np.int64), at + k])
    return np.cumsum((np.bincount(lo, minlength=size + 1) - np.bincount(hi, minlength=size + 1))[:-1]) > 0


def edges(runs: pa.StructArray, size: int, k: int, starts: Callable[[dict], np.ndarray]) -> np.ndarray:
    """covered(), where starts() gives the removed windows of each run that has a verdict."""
    start, n = runs.field("start").to_numpy(zero_copy_only=False), runs.field("n").to_numpy(zero_copy_only=False)
    known = np.flatnonzero(runs.field("many").is_valid().to_numpy(zero_copy_only=False)).tolist()
    return covered(runs, size, k, np.concatenate([np.zeros(0, np.int64), *(int(start[i]) + starts(runs[i], int(n[i])) for i in known)]))


class Repeats:
    """The stages above for texts (doc_id, text). judge(k) makes a function for applyInArrow over a bucket's strings
    (mh, dg, first, places, n, s), which returns JUDGED."""

    def __init__(self, docs: DataFrame, unit, k: int, m: int, name: str, bucket_strings: int, ws: Workspace | None = None):
        self.docs, self.unit, self.k, self.m, self.bucket_strings = docs, unit, k, m, bucket_strings
        self.ws = ws or Workspace(docs.sparkSession, name)
        self.base = self.ws.put(docs.mapInArrow(_runs(unit, k, m), BASE), "base")

    def verdicts(self, judge: Callable, across_ids: bool) -> DataFrame:
        """(doc_id, tag, start, n, first, places, lo, firsts, any, many) of every run whose minimiser occurs again.

        across_ids: only minimisers of several ids matter. Rows with a null id take no part.
        """
        runs = self.base.where("doc_id is not null").select("doc_id", "tag", F.explode("runs").alias("r")).select("doc_id", "tag", "r.*")
        if across_ids:
            shared = runs.groupBy("mh").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("mh")
        else:
            shared = runs.groupBy("mh").agg(F.count("*").alias("c")).where("c > 1").select("mh")
        shared = self.ws.put(shared, "shared", "lz4")
        again = self.ws.put(restrict(runs, "mh", shared, "mh").join(shared, "mh"), "again", "lz4")
        strings = again.groupBy("mh", "dg").agg(F.min("doc_id").alias("first"), F.count("*").alias("places"), F.min(F.struct("doc_id", "tag", "start", "n")).alias("at"))
        strings = self.ws.put(strings.select("mh", "dg", "first", "places", "at.doc_id", "at.tag", "at.start", "at.n"), "strings")
        several = strings.groupBy("mh").agg(F.count("*").alias("c"), F.max("n").alias("longest")).where("c > 1")
        want = self.ws.put(strings.join(several, "mh"), "want")
        per_doc = want.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("mh", "dg", "start", "n", "first", "places")).alias("want"))
        texts = restrict(self.docs.where("doc_id is not null"), "doc_id", want, "doc_id").join(per_doc, "doc_id").select("text", "tag", "want")
        cut = texts.mapInArrow(_cut(self.unit, self.k), "mh long, dg long, first long, places long, n int, s binary")
        # A repeated row gives its strings twice; one is enough.
        cut = self.ws.put(cut.dropDuplicates(["mh", "dg"]) if self.has_repeats() else cut, "cut")
        crowd = several.where(f"c > {HOT_STRINGS}").select("mh")
        calm = cut.join(several.where(f"c <= {HOT_STRINGS}").select("mh", F.least(F.floor(F.col("longest") / 16), F.lit(31)).cast("int").alias("class")), "mh")
        hot = cut.join(crowd, "mh", "left_semi")
        # Buckets of strings of like length, so a bucket's rounds end together; at most 32 classes.
        calm = self.ws.put(calm, "calm")
        sizes = {r["class"]: max(1, -(-r["count"] // self.bucket_strings)) for r in calm.groupBy("class").count().collect()} or {0: 1}
        buckets = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("class"))
        # As many tasks as buckets: by their bytes, which say little of the time they take, they would be put together.
        judged = calm.withColumn("bucket", F.pmod(F.xxhash64("mh"), buckets)).repartition(min(MOST_TASKS, sum(sizes.values())), "class", "bucket")
        judged = judged.groupBy("class", "bucket").applyInArrow(judge(self.k), JUDGED)
        if hot.limit(1).count():
            win = self.ws.put(hot.mapInArrow(_windows(self.unit, self.k), "mh long, dg long, i int, first long, places long, w binary"), "windows")
            each = self.ws.put(win.groupBy("mh", "w").agg(F.min("first").alias("lo"), F.sum("places").alias("c")), "each")
            single = win.join(each, ["mh", "w"]).groupBy("mh", "dg").agg(F.array_sort(F.collect_list(F.struct("i", "lo", (F.col("c") > 1).alias("many")))).alias("x"))
            judged = judged.unionByName(single.select("mh", "dg", F.transform("x", lambda x: x["lo"]).alias("firsts"), F.transform("x", lambda x: x["many"]).alias("many")).mapInArrow(_pack, JUDGED))
        judged = self.ws.put(judged, "judged")
        # A table, so that the join below is of two exchanges and a string with very many places can be split.
        known = self.ws.put(strings.select("mh", "dg", "first", "places").join(judged, ["mh", "dg"], "left"), "known")
        return again.join(known, ["mh", "dg"]).select("doc_id", "tag", "start", "n", "first", "places", "lo", "firsts", "any", "many")

    def has_repeats(self) -> bool:
        r = self.base.where("doc_id is not null").groupBy("doc_id", "tag").count().where("count > 1").limit(1).count()
        return bool(r)
