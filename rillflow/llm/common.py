"""Shared folders, bounded filters and connected components used by several operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

WORD_SPLIT = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Membership filters have this many bits whatever the input's size (2 MiB when broadcast).
FILTER_BITS = 1 << 24
_PAGE_BITS = 32768


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one of our own only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="rillflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Workspace:
    """Intermediate tables under the shared folder; every one is Parquet, so a lost executor loses none of it."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.root = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        schema = df.schema
        df.write.option("compression", codec).mode("overwrite").parquet(self.path(name))
        del df
        # Shuffle files go when the driver's JVM finds that nothing refers to them; the next step may need the disk.
        self.spark._jvm.System.gc()
        return self.get(name, schema)

    def get(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(conf).delete(p, True)


def words_of(text):
    """Words as an array column: maximal runs without ASCII white space; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), lambda w: w != "")


def ascii_lower(text):
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def _bit(col):
    return F.pmod(F.xxhash64(col), F.lit(FILTER_BITS))


def filter_of(ids: DataFrame, id_col: str) -> DataFrame:
    """(page, bits): a bitmap of FILTER_BITS bits of the ids, at most 2 MiB whatever their number."""
    bits = ids.select(_bit(F.col(id_col)).alias("b"))
    return bits.groupBy(F.expr(f"b div {_PAGE_BITS}").alias("page")).agg(F.bitmap_construct_agg((F.col("b") % _PAGE_BITS)).alias("bits"))


def may_hold(df: DataFrame, col: str, pages: DataFrame, inside: bool = True) -> DataFrame:
    """Rows of df whose col a filter lets through (inside=False: the others), without a shuffle of df."""
    own = uuid.uuid4().hex  # df may have columns of any name
    b, page, bits = f"b_{own}", f"page_{own}", f"bits_{own}"
    out = df.withColumn(b, _bit(F.col(col))).withColumn(page, F.expr(f"{b} div {_PAGE_BITS}"))
    out = out.join(F.broadcast(pages.select(F.col("page").alias(page), F.col("bits").alias(bits))), page, "left")
    at = F.expr(f"cast({b} % {_PAGE_BITS} as int)")
    byte = F.conv(F.hex(F.expr(f"substring({bits}, cast(({b} % {_PAGE_BITS}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))
    return out.where(hit if inside else ~hit).drop(b, page, bits)


def restrict(df: DataFrame, col: str, ids: DataFrame, id_col: str, inside: bool = True) -> DataFrame:
    """Rows of df whose col may be in ids: a superset of the semi join, without a shuffle of df. inside=False: the others.

    What is broadcast is bounded; as the filter fills up it only lets more rows through to the exact join that must follow.
    """
    return may_hold(df, col, filter_of(ids, id_col), inside)


def components(spark: SparkSession, edges: DataFrame, ws: Workspace, a: str = "a", b: str = "b", name: str = "cc") -> DataFrame:
    """(node, component): the smallest node reachable over the edges, for every node with an edge.

    Alternates large-star and small-star steps until the edges are stars. Minima are combined before the shuffle and
    joined back, so a node with very many edges can be split over tasks; each round is a table in the shared folder.
    """
    cur = ws.put(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), f"{name}0")
    last, i = None, 0
    while True:
        i += 1
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        new = ws.put(small.select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct(), f"{name}{i}")
        ws.drop(f"{name}{i - 1}")
        now = new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == last:
            break
        cur, last = new, tuple(now)
    stars = new.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
