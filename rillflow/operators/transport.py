"""Versioned commits, outbox, publication and receipts, shadow scoring, reconciliation."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_visible(versions: DataFrame) -> DataFrame:
    return versions.groupBy("event_id").agg(F.min("version").alias("first_version"), F.min_by("fingerprint", "version").alias("fingerprint"))


def read_version(versions: DataFrame, version: int) -> DataFrame:
    """The table as of a version: only commits up to it."""
    return versions.where(F.col("version") <= version)


def version_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per event of two snapshots: ADDED, REMOVED, CHANGED or SAME."""
    d = old.select("event_id", F.col("fingerprint").alias("a")).join(new.select("event_id", F.col("fingerprint").alias("b")), "event_id", "full_outer")
    return d.select("event_id", F.when(F.col("a").isNull(), "ADDED").when(F.col("b").isNull(), "REMOVED").when(F.col("a") != F.col("b"), "CHANGED").otherwise("SAME").alias("change"))


def commit_segments(versions: DataFrame, last: int) -> DataFrame:
    """Per version 0..last: events it brought and events visible after it; empty commits have their row."""
    spark = versions.sparkSession
    every = spark.range(last + 1).select(F.col("id").alias("version"))
    n = versions.groupBy("version").agg(F.count("*").alias("added"))
    d = every.join(n, "version", "left").na.fill(0, ["added"])
    w = Window.orderBy("version").rowsBetween(Window.unboundedPreceding, 0)  # a row for each commit
    return d.select("version", "added", F.sum("added").over(w).alias("visible"), (F.sum("added").over(w) - F.col("added")).alias("visible_before"))


def ready_id(version: Column, table: str, event: Column, fingerprint: Column) -> Column:
    return F.sha2(F.concat_ws("|", version.cast("string"), F.lit(table), event.cast("string"), fingerprint), 256)


def outbox(versions: DataFrame, table: str = "features") -> DataFrame:
    """One notification per event at its first visible version, in (version, event) order within the version's segment."""
    w = Window.partitionBy("first_version").orderBy("event_id")
    d = first_visible(versions)
    return d.select("event_id", "first_version", "fingerprint", ready_id(F.col("first_version"), table, F.col("event_id"), F.col("fingerprint")).alias("ready_event_id"), (F.row_number().over(w) - 1).cast("long").alias("position"))


def ready_envelope(out: DataFrame, table: str = "features") -> DataFrame:
    """Canonical JSON line of each notification and its size in bytes."""
    d = out.select("ready_event_id", F.to_json(F.struct(F.lit("feature-ready-v1").alias("availability_contract_version"), F.lit("READY").alias("availability_state"), F.col("event_id").cast("string").alias("event_id"), F.col("first_version").alias("first_visible_delta_version"), "ready_event_id", F.lit(table).alias("source_delta_table_id"), F.col("fingerprint").alias("source_feature_row_fingerprint"))).alias("json"))
    return d.withColumn("bytes", F.octet_length(F.concat("json", F.lit("\n"))).cast("long"))


def pending(out: DataFrame, acks: DataFrame, limit: int) -> DataFrame:
    """The first `limit` notifications without an acknowledgement, by (version, event): one publication's work."""
    return out.join(acks.select("ready_event_id"), "ready_event_id", "left_anti").orderBy("first_version", "event_id").limit(limit)


def receipts(deliveries: DataFrame) -> DataFrame:
    """Per notification: first coordinate, deliveries, duplicates and whether payloads agree."""
    g = deliveries.groupBy("ready_event_id").agg(F.min(F.struct("partition", "offset")).alias("first"), F.count("*").alias("deliveries"), F.countDistinct("payload").alias("payloads"))
    return g.select("ready_event_id", F.col("first.partition").alias("partition"), F.col("first.offset").alias("offset"), "deliveries", (F.col("deliveries") - 1).alias("duplicates"), (F.col("payloads") == 1).alias("consistent"))


def offset_gaps(deliveries: DataFrame) -> DataFrame:
    """Per partition: range, count and whether offsets follow each other without a gap."""
    g = deliveries.groupBy("partition").agg(F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), F.countDistinct("offset").alias("offsets"))
    return g.withColumn("contiguous", F.col("last_offset") - F.col("first_offset") + 1 == F.col("offsets"))


def transport_reconcile(out: DataFrame, acks: DataFrame, deliveries: DataFrame) -> DataFrame:
    """One row: prepared, acknowledged, received, physical records, duplicates, and what is missing on either side."""
    tag = lambda df, n: df.select("ready_event_id", *[F.lit(int(n == x)).alias(x) for x in ("o", "a", "r")])
    d = tag(out, "o").unionByName(tag(acks, "a")).unionByName(tag(deliveries, "r")).groupBy("ready_event_id").agg(*[F.sum(c).alias(c) for c in ("o", "a", "r")])
    n = lambda c: F.count(F.when(c, 1))
    o, a, r = F.col("o") > 0, F.col("a") > 0, F.col("r") > 0
    return d.agg(n(o).alias("prepared"), n(a).alias("acknowledged"), n(r).alias("received"), F.sum("r").alias("physical"), (F.sum("r") - n(r)).alias("duplicates"), n(o & ~a).alias("unacknowledged"), n(a & ~r).alias("unreceived"), n(r & ~o).alias("unexpected"))


def replay_plan(scored: DataFrame, candidate: str) -> DataFrame:
    """Request ids and sequence numbers by (ingestion time, event).

    Sequence numbers come from per-day counts and a number within the day, so no task orders all requests.
    """
    day = F.floor(F.col("ingestion_us") / 86_400_000_000)
    d = scored.select("event_id", "ingestion_us", day.alias("day"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # a row for each day
    base = d.groupBy("day").agg(F.count("*").alias("n")).select("day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("day").orderBy("ingestion_us", "event_id")) - 1
    return d.withColumn("own", own).join(base, "day").select("event_id", F.sha2(F.concat_ws("|", F.lit(candidate), F.col("event_id").cast("string")), 256).alias("request_id"), (F.col("base") + F.col("own")).cast("long").alias("replay_sequence"))


def first_delivery(deliveries: DataFrame, key: str = "request_id", order: str = "sequence") -> DataFrame:
    """Each request's first outcome and its later deliveries: REPEATED if equal, CONFLICT if not."""
    g = deliveries.groupBy(key).agg(F.min_by("payload", order).alias("payload"), F.count("*").alias("deliveries"), F.countDistinct("payload").alias("payloads"))
    return g.withColumn("status", F.when(F.col("payloads") > 1, "CONFLICT").when(F.col("deliveries") > 1, "REPEATED").otherwise("DELIVERED"))


def shadow_status(requests: DataFrame) -> DataFrame:
    """requests (in_scope, input_valid, p) with OUT_OF_SCOPE, INPUT_REJECTED, INFERENCE_FAILED or SCORED."""
    bad = F.col("p").isNull() | F.isnan("p") | (F.col("p") < 0) | (F.col("p") > 1)
    return requests.withColumn("execution_status", F.when(~F.col("in_scope"), "OUT_OF_SCOPE").when(~F.col("input_valid"), "INPUT_REJECTED").when(bad, "INFERENCE_FAILED").otherwise("SCORED"))


def parity(expected: DataFrame, actual: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """One row: compared, missing, unexpected, mismatched, and the greatest absolute and relative difference."""
    d = expected.select("event_id", F.col("p").alias("a")).join(actual.select("event_id", F.col("p").alias("b")), "event_id", "full_outer")
    gap = F.abs(F.col("a") - F.col("b"))
    return d.agg(
        F.count(gap).alias("compared"),
        F.count(F.when(F.col("b").isNull(), 1)).alias("missing"),
        F.count(F.when(F.col("a").isNull(), 1)).alias("unexpected"),
        F.count(F.when(gap > tolerance, 1)).alias("mismatched"),
        F.round(F.max(gap) + 1e-9, 6).alias("max_absolute"),
        F.round(F.max(F.when(F.col("a") != 0, gap / F.abs("a"))) + 1e-9, 6).alias("max_relative"),
    )


def stage_reconcile(stages: dict[str, DataFrame], key: str = "event_id") -> DataFrame:
    """Per stage, against the first: rows, distinct keys, missing, unexpected. One union and one grouping for all stages."""
    names = list(stages)
    d = None
    for n, df in stages.items():
        x = df.select(key, *[F.lit(int(m == n)).alias(m) for m in names])
        d = x if d is None else d.unionByName(x)
    d = d.groupBy(key).agg(*[F.sum(n).alias(n) for n in names])
    plan = F.col(names[0]) > 0
    rows = [F.struct(F.lit(n).alias("stage"), F.sum(n).alias("rows"), F.count(F.when(F.col(n) > 0, 1)).alias("distinct_keys"), F.count(F.when(plan & (F.col(n) == 0), 1)).alias("missing"), F.count(F.when(~plan & (F.col(n) > 0), 1)).alias("unexpected")) for n in names]
    return d.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def set_equal(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys only in a, only in b, in both; repeated keys count once."""
    d = a.select(key, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(key, F.lit(0).alias("x"), F.lit(1).alias("y"))).groupBy(key).agg(F.max("x").alias("x"), F.max("y").alias("y"))
    n = lambda c: F.count(F.when(c, 1))
    return d.agg(n((F.col("x") == 1) & (F.col("y") == 0)).alias("only_left"), n((F.col("x") == 0) & (F.col("y") == 1)).alias("only_right"), n((F.col("x") == 1) & (F.col("y") == 1)).alias("both"))


def progress(discovered: int, latest: int, prepared: DataFrame, accepted: DataFrame, results: DataFrame, limit: int) -> DataFrame:
    """One row of backlogs between stages, and IDLE, PROCESSING or PAUSED_BACKPRESSURE."""
    tag = lambda df, n: df.select("ready_event_id", *[F.lit(int(n == x)).alias(x) for x in ("o", "a", "r")])
    d = tag(prepared, "o").unionByName(tag(accepted, "a")).unionByName(tag(results, "r")).groupBy("ready_event_id").agg(*[F.sum(c).alias(c) for c in ("o", "a", "r")])
    n = lambda c: F.count(F.when(c, 1))
    o, a, r = F.col("o") > 0, F.col("a") > 0, F.col("r") > 0
    g = d.agg(n(o & ~a).alias("transport_backlog"), n(a & ~r).alias("inference_backlog"), n(o).alias("prepared"), n(a).alias("accepted"), n(r).alias("completed"), (F.coalesce(F.sum("a"), F.lit(0)) - n(a)).alias("duplicate_notifications"))
    g = g.withColumn("discovery_backlog", F.lit(latest - discovered).cast("long"))
    busy = (F.col("discovery_backlog") > 0) | (F.col("transport_backlog") > 0) | (F.col("inference_backlog") > 0)
    return g.withColumn("state", F.when(F.col("inference_backlog") >= limit, "PAUSED_BACKPRESSURE").when(busy, "PROCESSING").otherwise("IDLE"))


def publication_gate(batches: DataFrame, backlog: int, limit: int) -> DataFrame:
    """Which batch may be published: the earliest not accepted, no other being active, and room for it."""
    w = Window.orderBy("batch")  # a row for each batch
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.min(F.when(~F.col("accepted"), F.col("batch"))).over(whole)
    other = F.sum(F.col("active").cast("int")).over(whole) - F.col("active").cast("int")
    why = F.when(F.col("accepted"), "ALREADY_ACCEPTED").when(F.col("batch") != first, "NOT_EARLIEST").when(other > 0, "OTHER_ACTIVE").when(F.lit(backlog) + F.col("events") > limit, "PAUSED_BACKPRESSURE").otherwise("AUTHORISED")
    return batches.withColumn("decision", why)


def require_at_most(df: DataFrame, limit: int, what: str) -> DataFrame:
    """df, if it has no more than limit rows: a cap that fails instead of cutting. At most limit + 1 rows are looked at."""
    n = df.limit(limit + 1).count()
    if n > limit:
        raise ValueError(f"more than {limit} {what}")
    return df


def export_check(envelopes: DataFrame, by: str, max_events: int = 5000, max_bytes: int = 4096) -> DataFrame:
    """Per batch: events, bytes of the largest line, and whether it may be exported."""
    g = envelopes.groupBy(by).agg(F.count("*").alias("events"), F.max("bytes").alias("largest"))
    return g.withColumn("exportable", (F.col("events") <= max_events) & (F.col("largest") <= max_bytes))


def fence_gaps(batches: DataFrame) -> DataFrame:
    """batches (partition, batch, start_offset, end_offset): whether each starts where the one before ended, and how many
    records lie between or twice."""
    w = Window.partitionBy("partition").orderBy("batch")  # a row for each batch
    gap = F.col("start_offset") - F.lag("end_offset").over(w)
    return batches.withColumn("gap", F.coalesce(gap, F.lit(0))).withColumn("fence", F.when(F.col("gap") == 0, "CONTIGUOUS").when(F.col("gap") > 0, "GAP").otherwise("OVERLAP"))


def recovery_check(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows before and after a retry, and whether the tables are the same to the last row."""
    from ..functions.canonical import table_digest

    a, b = table_digest(before).withColumnsRenamed({"fingerprint": "fa", "rows": "rows_before"}), table_digest(after).withColumnsRenamed({"fingerprint": "fb", "rows": "rows_after"})
    return a.crossJoin(b).select("rows_before", "rows_after", (F.col("fa") == F.col("fb")).alias("unchanged"))  # one row each


def compare_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Counts by key of two observations side by side."""
    x, y = a.groupBy(key).agg(F.count("*").alias("left_rows")), b.groupBy(key).agg(F.count("*").alias("right_rows"))
    return x.join(y, key, "full_outer").na.fill(0, ["left_rows", "right_rows"]).withColumn("change", F.col("right_rows") - F.col("left_rows"))


def closure(spark, edges: DataFrame, start: str) -> DataFrame:
    """Nodes reachable from start and their least depth; each round reads only the last round's nodes."""
    from ..sources.store import checkpointed

    seen = frontier = spark.createDataFrame([(start, 0)], "node string, depth int")
    for depth in count(1):
        nxt = frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node"), F.lit(depth).alias("depth")).distinct().join(seen, "node", "left_anti")
        nxt = checkpointed(nxt)
        if nxt.isEmpty():
            break
        seen, frontier = seen.unionByName(nxt), nxt
        if depth % 16 == 0:  # plans stay short at any depth
            seen = checkpointed(seen)
    return seen


def cycle_nodes(spark, edges: DataFrame) -> DataFrame:
    """Nodes on or behind a cycle: what is left after nodes without incoming edges are peeled off again and again."""
    from ..sources.store import checkpointed

    left = edges
    while True:
        sources = left.select(F.col("src").alias("n")).distinct().join(left.select(F.col("dst").alias("n")).distinct(), "n", "left_anti")
        nxt = checkpointed(left.join(sources, left.src == sources.n, "left_anti"))
        if nxt.count() == left.count():
            break
        left = nxt
    return left.select(F.col("src").alias("node")).distinct()
