"""Durable journals of delivery: publication attempts and acknowledgements, receipts before offsets, handoff, execution audit.

Every journal is a versioned table, appended once per (application, batch), so a step that is run again after a crash finds
what it wrote before and goes on from there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import VersionedTable
from .transport import pending

ATTEMPTS = "attempt string, step string, ready_event_id string, replay boolean"
ACKS = "ready_event_id string, attempt string"
RECEIPTS = "ready_event_id string, partition int, offset long, payload string, duplicate boolean"
OFFSETS = "partition int, next_offset long"


def refuse(condition, why: str):
    """A filter that is true, or fails the job where the condition holds."""
    return F.when(condition, F.raise_error(F.lit(why)).cast("boolean")).otherwise(True)


def require_in(cohort: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """The cohort's rows that the source has; one that it lacks fails the job."""
    seen = source.select(F.col(key).alias("_k")).distinct().withColumn("_seen", F.lit(True))
    d = cohort.join(seen, F.col(key) == F.col("_k"), "left")
    return d.where(refuse(F.col("_seen").isNull(), "the source lacks a row of the cohort")).select(*cohort.columns)


class PublicationJournal:
    """Attempts (START, DELIVERED, COMPLETE) and acknowledgements. At least once: what has no acknowledgement is sent again."""

    def __init__(self, spark: SparkSession, path: str):
        self.attempts = VersionedTable(spark, f"{path}/attempts", ATTEMPTS)
        self.acks = VersionedTable(spark, f"{path}/acks", ACKS)

    def _note(self, rows: DataFrame, attempt: str, step: str, replay: bool, number: int) -> None:
        d = rows.select(F.lit(attempt).alias("attempt"), F.lit(step).alias("step"), F.col("ready_event_id").cast("string").alias("ready_event_id"), F.lit(replay).alias("replay"))
        self.attempts.append(d, attempt, number)

    def publish(self, outbox: DataFrame, send: Callable[[DataFrame], DataFrame], attempt: str, limit: int) -> None:
        """Send the next `limit` notifications. send returns (ready_event_id, ok) of what it delivered."""
        self._send(pending(outbox, self.acks.read(), limit), send, attempt, False)

    def replay(self, rows: DataFrame, send: Callable[[DataFrame], DataFrame], attempt: str) -> None:
        """Send chosen notifications again: logged as deliveries, never acknowledged."""
        self._send(rows, send, attempt, True)

    def _send(self, rows: DataFrame, send, attempt: str, replay: bool) -> None:
        self._note(rows, attempt, "START", replay, 0)
        started = self.attempts.read().where((F.col("attempt") == attempt) & (F.col("step") == "START")).select("ready_event_id")
        sent = send(started)
        self._note(sent, attempt, "DELIVERED", replay, 1)
        if not replay:
            self.acks.append(sent.where("ok").select("ready_event_id", F.lit(attempt).alias("attempt")), attempt, 0)
        self._note(sent.sparkSession.createDataFrame([(None,)], "ready_event_id string"), attempt, "COMPLETE", replay, 2)


def receipt_grains(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of records (ready_event_id, partition, offset, payload): a row for each coordinate with the times it was read, and a
    row for each delivery, with whether the id had been received at an earlier coordinate."""
    seen = records.groupBy("partition", "offset").agg(F.min("ready_event_id").alias("ready_event_id"), F.count("*").alias("reads"))
    w = Window.partitionBy("ready_event_id").orderBy("partition", "offset", "payload")
    deliveries = records.withColumn("attempt", F.row_number().over(w)).withColumn("duplicate", F.col("attempt") > 1)
    return seen, deliveries.select("ready_event_id", "partition", "offset", "attempt", "duplicate")


def require_payloads(records: DataFrame, outbox: DataFrame) -> DataFrame:
    """records, if their payloads are the outbox's."""
    d = records.join(outbox.select("ready_event_id", F.col("payload").alias("_sent")), "ready_event_id", "left")
    return d.where(refuse(F.col("_sent").isNull() | (F.col("_sent") != F.col("payload")), "a payload differs from the outbox's")).drop("_sent")


class ReceiptConsumer:
    """Reads a log (ready_event_id, partition, offset, payload) behind a fence: offsets must follow on from those committed,
    receipts are durable before their offsets are."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.receipts = VersionedTable(spark, f"{path}/receipts", RECEIPTS)
        self.offsets = VersionedTable(spark, f"{path}/offsets", OFFSETS)

    def committed(self) -> DataFrame:
        return self.offsets.read().groupBy("partition").agg(F.max("next_offset").alias("next_offset"))

    def poll(self, log: DataFrame, number: int, between=None) -> None:
        """Accept what the log holds beyond the fence. between: runs when receipts are written and offsets are not (tests)."""
        ahead = log.join(self.committed(), "partition", "left").withColumn("from", F.coalesce("next_offset", F.lit(0))).where("offset >= from")
        fence = ahead.groupBy("partition").agg(F.min("from").alias("from"), F.min("offset").alias("lo"), F.max("offset").alias("hi"), F.countDistinct("offset").alias("n"))
        fence = fence.where(refuse((F.col("lo") != F.col("from")) | (F.col("hi") - F.col("lo") + 1 != F.col("n")), "offsets do not follow on from the fence"))
        had = self.receipts.read().select("partition", "offset", "ready_event_id")
        fresh = ahead.join(fence.select("partition"), "partition").join(had.select("partition", "offset"), ["partition", "offset"], "left_anti")
        known = had.select("ready_event_id").distinct().withColumn("_had", F.lit(True))
        w = Window.partitionBy("ready_event_id").orderBy("partition", "offset")
        rows = fresh.join(known, "ready_event_id", "left").withColumn("duplicate", F.coalesce("_had", F.lit(False)) | (F.row_number().over(w) > 1))
        self.receipts.append(rows.select("ready_event_id", "partition", "offset", "payload", "duplicate"), "poll", number)
        if between:
            between()
        self.offsets.append(fence.select("partition", (F.col("hi") + 1).cast("long").alias("next_offset")), "poll", number)


def seal(receipts: DataFrame) -> DataFrame:
    """Per partition of an inbox: its range and count of receipts and a digest of its ids that does not depend on their order."""
    part = F.conv(F.substring("ready_event_id", 1, 8), 16, 10).cast("long")
    return receipts.groupBy("partition").agg(F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), F.count("*").alias("receipts"), F.sum(part).alias("digest"))


def require_seal(receipts: DataFrame, sealed: DataFrame) -> DataFrame:
    """receipts, if they are those that were sealed."""
    now = seal(receipts).select("partition", *[F.col(c).alias(f"_{c}") for c in ("first_offset", "last_offset", "receipts", "digest")])
    both = sealed.join(now, "partition", "full_outer")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("first_offset", "last_offset", "receipts", "digest")]
    ok = both.where(refuse(~(same[0] & same[1] & same[2] & same[3]), "the inbox is not the one that was sealed")).select("partition")
    return receipts.join(ok, "partition", "left_semi")


def handoff(outbox: DataFrame, receipts: VersionedTable, deliver: Callable[[DataFrame], None], number: int, limit: int) -> None:
    """Deliver at most `limit` notifications that have no durable receipt, then write their receipts. Run again after a crash
    it delivers the same ones again (deliver must be idempotent) and goes on where it stopped."""
    work = pending(outbox, receipts.read(), limit).select("ready_event_id")
    deliver(work)
    receipts.append(work, "handoff", number)


def execution_audit(deliveries: DataFrame) -> DataFrame:
    """Each delivery (request_id, sequence, payload) of a request with what became of it: the first is EXECUTED, a later one is
    REPEATED with the first's outcome if its payload is the same and CONFLICT if not; numbered within its request."""
    w = Window.partitionBy("request_id").orderBy("sequence")
    d = deliveries.withColumn("audit_sequence", F.row_number().over(w)).withColumn("outcome", F.first("payload").over(w))
    result = F.when(F.col("audit_sequence") == 1, "EXECUTED").when(F.col("payload") == F.col("outcome"), "REPEATED").otherwise("CONFLICT")
    return d.select("request_id", "sequence", "audit_sequence", "outcome", result.alias("result"))


def backlog_series(events: DataFrame, every_us: int) -> DataFrame:
    """events (arrived_us, accepted_us, completed_us; null: not yet) at the end of every interval: what waits for acceptance and
    for completion. Sums by interval, then running sums over a row for each interval."""
    at = lambda c: F.floor(F.col(c) / every_us)
    one = lambda c, a, b, x: events.where(F.col(c).isNotNull()).select(at(c).alias("interval"), *[F.lit(v).alias(n) for n, v in (("arrived", a), ("accepted", b), ("completed", x))])
    d = one("arrived_us", 1, 0, 0).unionByName(one("accepted_us", 0, 1, 0)).unionByName(one("completed_us", 0, 0, 1))
    d = d.groupBy("interval").agg(*[F.sum(c).alias(c) for c in ("arrived", "accepted", "completed")])
    w = Window.orderBy("interval").rowsBetween(Window.unboundedPreceding, 0)
    total = {c: F.sum(c).over(w) for c in ("arrived", "accepted", "completed")}
    return d.select("interval", (total["arrived"] - total["accepted"]).alias("waiting"), (total["accepted"] - total["completed"]).alias("in_work"))
