"""Exact deduplication with a log-structured merge index over digests. DataFrame operations only.

Memtables are the input's own tasks: each one's rows are sorted by digest and flushed as one run of level 0, with a filter of
its digests. Compaction merges FANOUT runs of a level at a time into one sorted run of the next, in which every digest keeps
one identifier and its number of rows, until one run is left; each level has a filter of its own. Probes go through the
filters: a digest that a filter excludes is not looked up. The filter of the digests that occur again thus keeps the rows of
all others out of every shuffle. Rows whose digest occurs again are hits: their normalised texts are compared byte by byte.

Defined cases: a null text counts as empty; empty texts equal each other; of rows repeated with the same id and text, all
are returned and one is kept; a null id orders before every other (it stays only if its whole group has none); an empty
table gives an empty result; other columns, whatever their names, are ignored. Should two different texts ever have one
digest, the byte check finds it and all rows of that digest are kept and marked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, ascii_lower, filter_of, may_hold, restrict

#: Runs that one merge takes together.
FANOUT = 16
_RUN = "run long, digest string, id long, row long, size long"


class DigestIndex:
    """Levels of sorted runs of (digest, id, row, size) under a workspace. keep: 'smallest' or 'largest' identifier stays.

    The index takes further flushes after a compaction; the next one merges them with the run that there is.
    """

    def __init__(self, spark: SparkSession, ws: Workspace, keep: str = "smallest", fanout: int = FANOUT):
        if keep not in ("smallest", "largest"):
            raise ValueError("keep is smallest or largest")
        if fanout < 2:
            raise ValueError("a merge takes two runs or more")
        self.spark, self.ws, self.keep, self.fanout = spark, ws, keep, fanout
        self.flushes = self.merges = 0
        #: Tables that hold the index now, and how many runs each has.
        self.tables: list[tuple[str, int]] = []

    def _write(self, rows: DataFrame, name: str) -> DataFrame:
        out = self.ws.put(rows.sortWithinPartitions("run", "digest", "id"), name)
        self.ws.put(filter_of(out, "digest"), f"{name}-filter")
        return out

    def flush(self, rows: DataFrame) -> DataFrame:
        """Write (id, row, digest) as sorted runs, one for each task's memtable; no shuffle. Returns them."""
        name = f"flush-{self.flushes}"
        self.flushes += 1
        out = self._write(rows.select(F.spark_partition_id().cast("long").alias("run"), "digest", "id", "row", F.lit(1).cast("long").alias("size")), name)
        self.tables.append((name, 1 + (out.agg(F.max("run")).first()[0] or 0)))
        return out

    def _runs(self) -> DataFrame:
        """All runs, numbered over the tables."""
        out, first = None, 0
        for name, runs in self.tables:
            t = self.ws.get(name, _RUN).withColumn("run", F.col("run") + first)
            out, first = t if out is None else out.unionByName(t), first + runs
        return out

    def compact(self) -> DataFrame:
        """Merge to one run: (digest, id, row, size), a row for every digest. What a task holds is combined before it is sent."""
        best = (F.min if self.keep == "smallest" else F.max)(F.struct("id", "row")).alias("best")
        while True:
            runs = sum(n for _, n in self.tables)
            name = f"merge-{self.merges}"
            self.merges += 1
            merged = self._runs().groupBy(F.expr(f"run div {self.fanout}").alias("run"), "digest").agg(best, F.sum("size").alias("size"))
            out = self._write(merged.select("run", "digest", F.col("best.id").alias("id"), F.col("best.row").alias("row"), "size"), name)
            old, self.tables = self.tables, [(name, -(-runs // self.fanout))]
            self.ws.drop(*(x for n, _ in old if n.startswith("merge-") for x in (n, f"{n}-filter")))
            if self.tables[0][1] == 1:
                return out.drop("run")

    def probe(self, digests: DataFrame) -> DataFrame:
        """Entries of the runs with one of the digests. Each table is asked only for digests that its filter lets through."""
        out = None
        for name, _ in self.tables:
            may = may_hold(digests.select("digest").distinct(), "digest", self.ws.get(f"{name}-filter"))
            t = restrict(self.ws.get(name, _RUN), "digest", may, "digest").join(may, "digest", "left_semi")
            out = t if out is None else out.unionByName(t)
        return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", row_col: str | None = None, ws: Workspace | None = None) -> DataFrame:
    """One row per input row: id, row, keep_id, group_size, kept, text_sha256, digest_clash. Equality ignores the case of A-Z.

    row_col: a column that numbers the rows; else they are numbered as they are flushed.
    """
    spark = docs.sparkSession
    ws = ws or Workspace(spark, "exact")
    index = DigestIndex(spark, ws, keep)
    row = F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id()
    src = docs.select(F.col(id_col).cast("long").alias("id"), row.alias("row"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    digest = F.sha2(F.col("norm").cast("binary"), 256).alias("digest")
    rows = index.flush(src.select("id", "row", digest)).select("id", "row", "digest")
    again = ws.put(index.compact().where("size > 1").select("digest", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("size").alias("group_size")), "again")
    pages = ws.put(filter_of(again, "digest"), "again-filter")
    # Byte verification of hits: the least and the greatest text of a digest are one text.
    texts = may_hold(src.select(digest, "norm"), "digest", pages)
    clash = texts.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).where("lo <> hi").select("digest", F.lit(True).alias("clash"))
    again = ws.put(again.join(clash, "digest", "left"), "verified")
    once = may_hold(rows, "digest", pages, inside=False).select("*", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"), F.lit(None).cast("boolean").alias("clash"))
    hits = may_hold(rows, "digest", pages).join(again, "digest", "left")
    alone = F.col("group_size").isNull()  # the filter let it through for another's sake
    hits = hits.select("id", "row", "digest", F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.when(alone, F.col("row")).otherwise(F.col("keep_row")).alias("keep_row"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "clash")
    out = once.select(hits.columns).unionByName(hits).withColumn("digest_clash", F.coalesce("clash", F.lit(False)))
    return out.select("id", "row", "keep_id", "group_size", (F.col("digest_clash") | (F.col("row") == F.col("keep_row"))).alias("kept"), F.col("digest").alias("text_sha256"), "digest_clash")
