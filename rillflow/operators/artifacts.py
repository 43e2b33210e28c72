"""Content-addressed artifacts, inventories and bundles."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.canonical import table_digest


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def publish(df: DataFrame, root: str, facts: dict) -> dict:
    """Write df as Parquet under the digest of its rows, schema and facts; the same content is published once.

    Data is written beside its place and renamed, so a reader sees all of it or nothing.
    """
    spark = df.sparkSession
    df = df.persist()
    try:
        row = table_digest(df).first()
        identity = facts | {"schema": schemas.fingerprint(df), "rows": row.rows, "content": row.fingerprint}
        name = hashlib.sha256(json.dumps(identity, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        fs, place = _fs(spark, f"{root}/{name}")
        if not fs.exists(place):
            tmp = f"{root}/.{name}.tmp"
            df.write.mode("overwrite").parquet(f"{tmp}/data")
            _, t = _fs(spark, tmp)
            _, m = _fs(spark, f"{tmp}/manifest.json")
            out = fs.create(m, True)
            out.write(bytearray((json.dumps(identity, sort_keys=True) + "\n").encode()))
            out.close()
            if not fs.rename(t, place) and not fs.exists(place):
                raise OSError(f"cannot publish {place}")
    finally:
        df.unpersist()
    return identity | {"id": name, "path": f"{root}/{name}"}


def verify(spark: SparkSession, published: dict) -> bool:
    """Whether an artifact's rows still have the digest it was published under."""
    row = table_digest(spark.read.parquet(f"{published['path']}/data")).first()
    return row.fingerprint == published["content"] and row.rows == published["rows"]


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a path with its length and sha256."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return d.select(F.regexp_replace("path", "^.*?" + path.removeprefix("file://").rstrip("/") + "/", "").alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def bundle_errors(a: DataFrame, b: DataFrame) -> DataFrame:
    """Files of a bundle against a restored copy: MISSING, UNEXPECTED or CHANGED."""
    d = a.select("name", F.col("sha256").alias("x")).join(b.select("name", F.col("sha256").alias("y")), "name", "full_outer")
    return d.select("name", F.when(F.col("y").isNull(), "MISSING").when(F.col("x").isNull(), "UNEXPECTED").when(F.col("x") != F.col("y"), "CHANGED").alias("error")).where("error is not null")


def checkpoint_dirs(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes by first folder below a path: what state and logs take."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    rel = F.regexp_replace("path", "^.*?" + path.removeprefix("file://").rstrip("/") + "/", "")
    return d.groupBy(F.substring_index(rel, "/", 1).alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
