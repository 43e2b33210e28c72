"""Readers and writers of the text formats and of the message log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = {"event_id": "string", "outcome": "string", "label_observed_at": "string", "label_source": "string", "label_revision": "long"}
FEEDBACK = {"provider_id": "string", "provider_record_id": "string", "provider_case_id": "string", "source_revision": "long", "event_id": "string", "status": "string", "source_updated_at": "string", "received_at": "string"}
_UTC = "^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d{1,6})?(Z|\\+00:00)$"


def json_lines(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Strict JSON lines: exactly the fields, each of its type and not null, none twice. Bad lines have an error."""
    ddl = ", ".join(f"{n} {t}" for n, t in fields.items())
    d = spark.read.text(path).where("value <> ''").withColumn("r", F.from_json("value", ddl + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    keys = F.json_object_keys("value")
    named = F.array_sort(F.array(*[F.lit(n) for n in fields]))
    error = (
        F.when(keys.isNull() | F.col("r._bad").isNotNull(), "MALFORMED")
        .when(F.size(keys) != F.size(F.array_distinct(keys)), "DUPLICATE_KEY")
        .when(F.array_sort(keys) != named, "FIELDS_DIFFER")
        .when(F.greatest(*[F.col(f"r.{n}").isNull().cast("int") for n in fields]) == 1, "NULL_OR_WRONG_TYPE")
    )
    for n in fields:
        if n.endswith("_at"):
            error = error.when(~F.col(f"r.{n}").rlike(_UTC), "NOT_UTC")
    return d.select(*[F.col(f"r.{n}").alias(n) for n in fields], error.alias("error"))


def checked(rows: DataFrame) -> DataFrame:
    """rows without error; one bad line fails the job."""
    ok = F.when(F.col("error").isNull(), True).otherwise(F.raise_error(F.col("error")).cast("boolean"))
    return rows.where(ok).drop("error")


def labels(spark: SparkSession, path: str) -> DataFrame:
    d = checked(json_lines(spark, path, LABELS))
    return d.select("event_id", "outcome", F.unix_micros(F.col("label_observed_at").cast("timestamp")).alias("observed_us"), "label_source", F.col("label_revision").alias("revision"))


def feedback(spark: SparkSession, path: str) -> DataFrame:
    d = checked(json_lines(spark, path, FEEDBACK))
    return d.withColumns({"received_us": F.unix_micros(F.col("received_at").cast("timestamp")), "updated_us": F.unix_micros(F.col("source_updated_at").cast("timestamp"))})


MESSAGES = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp"


def kafka_stream(spark: SparkSession, servers: str, topic: str, starting: str = "earliest") -> DataFrame:
    """The broker's stream with its six columns; needs the connector on the class path."""
    d = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).option("failOnDataLoss", "true").load()
    return d.select("key", "value", "topic", "partition", "offset", "timestamp")


def log_stream(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """A Parquet message log of the same shape, for where there is no broker."""
    return spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", max_files).parquet(path)


def append_log(records: DataFrame, path: str, topic: str, partitions: int, first_offsets: dict[int, int] | None = None, order: str = "order") -> None:
    """Publish (key, value, order): the key's hash chooses the partition, offsets follow the order within it."""
    from pyspark.sql import Window

    p = F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int")
    base = F.lit(0)
    for part, off in (first_offsets or {}).items():
        base = F.when(F.col("partition") == part, off).otherwise(base)
    d = records.withColumn("partition", p)
    n = F.row_number().over(Window.partitionBy("partition").orderBy(order)) - 1
    d = d.select("key", "value", F.lit(topic).alias("topic"), "partition", (n + base).cast("long").alias("offset"), F.current_timestamp().alias("timestamp"))
    d.repartition(partitions, "partition").sortWithinPartitions("partition", "offset").write.mode("append").parquet(path)
