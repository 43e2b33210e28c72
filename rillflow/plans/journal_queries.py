"""Journals, receipts, handoff, audit and backlog as queries, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import journals as J
from ..operators import transport as T
from ..sources import events as E
from ..sources.events import DAY_US, with_views
from ..sources.store import VersionedTable
from .stream_queries import _root
from .transport_queries import _V, _deliveries, _tx, _versions

LIMIT = 300


def publication_journal(spark, d):
    """Two attempts, of which every seventh delivery fails, and a replay of the first: what each started and what was acknowledged."""
    out = T.outbox(_versions(spark, d))
    journal = J.PublicationJournal(spark, _root(spark))
    event = out.select("ready_event_id", "event_id")
    send = lambda rows: rows.join(event, "ready_event_id").select("ready_event_id", (F.col("event_id") % 7 != 3).alias("ok"))
    journal.publish(out, send, "a1", LIMIT)
    journal.publish(out, send, "a2", LIMIT)
    journal.replay(journal.acks.read().where("attempt = 'a1'").select("ready_event_id"), send, "r1")
    steps = journal.attempts.read().groupBy("attempt").agg(F.count(F.when(F.col("step") == "START", 1)).alias("started"), F.count(F.when(F.col("step") == "DELIVERED", 1)).alias("delivered"), F.count(F.when(F.col("step") == "COMPLETE", 1)).alias("completed"))
    return steps.join(journal.acks.read().groupBy("attempt").agg(F.count("*").alias("acks")), "attempt", "left").na.fill(0, ["acks"])


def _log(spark, d) -> DataFrame:
    """Every notification on one of three partitions, at offsets without gaps."""
    out = T.outbox(_versions(spark, d)).select("ready_event_id", "event_id", (F.col("event_id") % 3).cast("int").alias("partition"))
    return out.select("ready_event_id", "partition", (F.row_number().over(Window.partitionBy("partition").orderBy("event_id")) - 1).cast("long").alias("offset"), F.lit("p").alias("payload"))


def consumer_receipts(spark, d):
    """A first poll, a second one that stops before its offsets are committed, and that one again."""
    log = _log(spark, d)
    consumer = J.ReceiptConsumer(spark, _root(spark))
    consumer.poll(log.where("offset < 50"), 0)

    def crash():
        raise InterruptedError

    try:
        consumer.poll(log, 1, crash)
    except InterruptedError:
        pass
    consumer.poll(log, 1)
    r = consumer.receipts.read().groupBy("partition").agg(F.count("*").alias("receipts"), F.count(F.when(F.col("duplicate"), 1)).alias("duplicates"))
    return r.join(consumer.committed(), "partition")


def receipt_observations(spark, d):
    return J.receipt_grains(_deliveries(spark, d))[0]


def receipt_deliveries(spark, d):
    return J.receipt_grains(_deliveries(spark, d))[1]


def inbox_seal(spark, d):
    r = _log(spark, d)
    return J.seal(J.require_seal(r, J.seal(r)))


def handoff_restart(spark, d):
    """Three rounds, the second of which first fails in delivery: receipts by round."""
    out = T.outbox(_versions(spark, d))
    receipts = VersionedTable(spark, _root(spark), "ready_event_id string")

    def fail(rows):
        raise InterruptedError

    for n, deliver in ((0, lambda rows: None), (1, fail), (1, lambda rows: None), (2, lambda rows: None)):
        try:
            J.handoff(out, receipts, deliver, n, LIMIT)
        except InterruptedError:
            pass
    return receipts.read().groupBy(F.col("_version").alias("round")).agg(F.count("*").alias("receipts"), F.min("ready_event_id").alias("first_id"))


def execution_audit(spark, d):
    x = _deliveries(spark, d).select(F.col("ready_event_id").alias("request_id"), F.col("offset").alias("sequence"), "payload")
    return J.execution_audit(x)


def cohort_guard(spark, d):
    p = E.predictions(_tx(spark, d)).select("event_id", "currency")
    return J.require_in(p.where("event_id % 3 = 1"), _tx(spark, d), "event_id").groupBy("currency").agg(F.count("*").alias("rows"))


def wave_fixture(spark, d):
    """Three waves appended to a table of their own: each gets the next version."""
    tx = _tx(spark, d).select("event_id", "wave")
    table = VersionedTable(spark, _root(spark), "event_id long, wave int")
    for w in (0, 1, 2):
        table.append_wave(tx.where(F.col("wave") == w), "fixture", w)
    return table.read().groupBy("wave", F.col("_version").alias("version")).agg(F.count("*").alias("rows"))


def outage_backlog(spark, d):
    """Notifications accepted at once except in an outage of five days, after which all that waited are, and completed a day later."""
    day = F.floor(F.col("event_us") / DAY_US)
    out = (day % 30).between(10, 14)
    accepted = F.when(out, (day - day % 30 + 15) * DAY_US).otherwise(F.col("event_us"))
    x = _tx(spark, d).select(F.col("event_us").alias("arrived_us"), accepted.cast("long").alias("accepted_us"))
    return J.backlog_series(x.withColumn("completed_us", F.when(F.col("accepted_us") % 5 != 1, F.col("accepted_us") + DAY_US)), DAY_US)


_DEL = f"{_V}, acked as (select ready_event_id, event_id, event_id % 3 as p, event_id as o, 'p' as payload from ob where event_id % 7 <> 3), del as (select * from acked union all select ready_event_id, event_id, p, o + 1000000000, case when event_id % 77 = 0 then 'q' else payload end from acked where event_id % 11 = 0)"
_RANKED = f"{_V}, n as (select *, row_number() over (order by first_version, event_id) as rn from ob)"

QUERIES = {
    "publication_journal": (publication_journal, f"{_RANKED}, a1 as (select * from n where rn <= {LIMIT}), k1 as (select * from a1 where event_id % 7 <> 3), a2 as (select * from n where rn not in (select rn from k1) order by rn limit {LIMIT}), k2 as (select * from a2 where event_id % 7 <> 3) select 'a1' as attempt, (select count(*) from a1) as started, (select count(*) from a1) as delivered, 1 as completed, (select count(*) from k1) as acks union all select 'a2', (select count(*) from a2), (select count(*) from a2), 1, (select count(*) from k2) union all select 'r1', (select count(*) from k1), (select count(*) from k1), 1, 0"),
    "consumer_receipts": (consumer_receipts, f"{_V} select cast(event_id % 3 as int) as partition, count(*) as receipts, 0 as duplicates, count(*) as next_offset from ob group by 1"),
    "receipt_observations": (receipt_observations, f"{_DEL} select cast(p as int) as partition, o as \"offset\", min(ready_event_id) as ready_event_id, count(*) as reads from del group by 1, 2"),
    "receipt_deliveries": (receipt_deliveries, f"{_DEL} select ready_event_id, cast(p as int) as partition, o as \"offset\", cast(row_number() over (partition by ready_event_id order by p, o, payload) as int) as attempt, row_number() over (partition by ready_event_id order by p, o, payload) > 1 as duplicate from del"),
    "inbox_seal": (inbox_seal, f"{_V} select cast(event_id % 3 as int) as partition, 0 as first_offset, count(*) - 1 as last_offset, count(*) as receipts, cast(sum(cast('0x' || substr(ready_event_id, 1, 8) as bigint)) as bigint) as digest from ob group by 1"),
    "handoff_restart": (handoff_restart, f"{_RANKED} select cast((rn - 1) // {LIMIT} as bigint) as round, count(*) as receipts, min(ready_event_id) as first_id from n where rn <= 3 * {LIMIT} group by 1"),
    "execution_audit": (execution_audit, f"{_DEL}, r as (select ready_event_id as request_id, o as sequence, payload, row_number() over w as k, first(payload) over w as outcome from del window w as (partition by ready_event_id order by o)) select request_id, sequence, cast(k as int) as audit_sequence, outcome, case when k = 1 then 'EXECUTED' when payload = outcome then 'REPEATED' else 'CONFLICT' end as result from r"),
    "cohort_guard": (cohort_guard, f"{with_views()} select currency, count(*) as rows from tx where event_id % 3 = 1 group by 1"),
    "wave_fixture": (wave_fixture, f"{with_views()} select wave, cast(wave as bigint) as version, count(*) as rows from tx group by 1, 2"),
    "outage_backlog": (outage_backlog, f"{with_views()}, a as (select event_us, event_us // {DAY_US} as day from tx), b as (select day, case when day % 30 between 10 and 14 then (day - day % 30 + 15) * {DAY_US} else event_us end as acc from a), s as (select day as interval, 1 as x, 0 as y, 0 as z from b union all select acc // {DAY_US}, 0, 1, 0 from b union all select (acc + {DAY_US}) // {DAY_US}, 0, 0, 1 from b where acc % 5 <> 1), g as (select interval, sum(x) as x, sum(y) as y, sum(z) as z from s group by 1) select interval, cast(sum(x) over w - sum(y) over w as bigint) as waiting, cast(sum(y) over w - sum(z) over w as bigint) as in_work from g window w as (order by interval)"),
}
