"""Substring dedup over words: super-k-mer partitioning, with windows counted exactly by sorting in their buckets.

Every word is removed that lies in a window of k consecutive words which also starts in a document with a smaller id.
Windows are judged on the input. See repeats.py for the partitioning.

Defined cases: a null text has no words; texts of fewer than k words lose nothing; a null id neither removes nor loses
words; a window that repeats within one id only stays; rows that repeat an id and text are judged alike; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, restrict
from .repeats import Repeats, Words, edges, tag_of, verdict


def judge(k: int) -> Callable[[pa.Table], pa.Table]:
    def run(g: pa.Table) -> pa.Table:
        windows, size = [], []
        for at, (mh, n, s) in enumerate(zip(g["mh"].to_pylist(), g["n"].to_pylist(), g["s"].to_pylist(), strict=True)):
            ends = [-1, *np.flatnonzero(np.frombuffer(s, np.uint8) == 32).tolist(), len(s)]
            windows += [(mh, s[ends[i] + 1 : ends[i + k]], at, i) for i in range(n)]
            size.append(n)
        windows.sort()
        firsts = [np.zeros(n, np.int64) for n in size]
        many = [np.zeros(n, bool) for n in size]
        first, places = g["first"].to_pylist(), g["places"].to_pylist()
        i = 0
        while i < len(windows):
            j, key = i, windows[i][:2]
            while j < len(windows) and windows[j][:2] == key:
                j += 1
            lo, more = min(first[w[2]] for w in windows[i:j]), sum(places[w[2]] for w in windows[i:j]) > 1
            for _, _, at, p in windows[i:j]:
                firsts[at][p], many[at][p] = lo, more
            i = j
        return pa.Table.from_arrays([g["mh"], g["dg"], *verdict(firsts, many)], names=["mh", "dg", "lo", "firsts", "any", "many"])

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("tag", pa.int32()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def _remove(k: int, texts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in _OUT]
            for doc, tag, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                words = (text.as_py() or "").encode().split()
                if tag_of(b" ".join(words)) != tag:
                    continue
                gone = edges(runs.values, len(words), k, lambda r, n, d=doc: np.flatnonzero(np.frombuffer(r["firsts"].as_buffer(), "<i8") < d))
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                for c, v in zip(cols, (doc, tag, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT, strict=True)], schema=_OUT)

    return run


def substring_dedup(docs: DataFrame, k: int = 50, m: int = 12, texts: bool = False, id_col: str = "doc_id", text_col: str = "text", ws: Workspace | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256; texts: with kept_text, null where nothing went.

    m: words of a minimiser, fewer than k.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    r = Repeats(d, Words, k, m, "substring", 5_000, ws)
    runs = r.verdicts(judge, across_ids=True).where("coalesce(lo, first) < doc_id")
    per_doc = r.ws.put(runs.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "n", "firsts", "many")).alias("runs")), "per_doc")
    hit = restrict(d.where("doc_id is not null"), "doc_id", per_doc, "doc_id").join(per_doc, "doc_id").select("doc_id", "tag", "text", "runs")
    out = hit.mapInArrow(_remove(k, texts), "doc_id long, tag int, n_removed long, kept_sha256 string, kept_text string").dropDuplicates(["doc_id", "tag"])
    base = r.base.select("doc_id", F.col("size").alias("n_words"), "sha", "tag").join(out, ["doc_id", "tag"], "left")
    cols = ["doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")]
    return base.select(*cols, *(["kept_text"] if texts else []))
