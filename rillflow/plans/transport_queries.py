"""Commits, outbox, receipts, shadow scoring, reconciliation, workload, lineage, policy and corpus queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import transport as T
from ..sources import events as E
from ..sources import generator as G
from ..sources.events import DAY_US, with_views
from .event_queries import _FEAT, featured
from .monitoring_queries import _r, day


def _tx(spark, d):
    return E.transactions(spark, d)


def _versions(spark, d):
    return E.versions(_tx(spark, d))


def versioned_read(spark, d):
    return T.read_version(_versions(spark, d), 10).groupBy("version").agg(F.count("*").alias("rows"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def version_history(spark, d):
    return _versions(spark, d).groupBy("version").agg(F.count("*").alias("rows")).select("version", F.lit("WRITE").alias("operation"), "rows").orderBy(F.desc("version")).limit(20)


def first_visible(spark, d):
    return T.first_visible(_versions(spark, d))


def version_diff(spark, d):
    v = _versions(spark, d)
    new = v.where("event_id % 101 <> 0").withColumn("fingerprint", F.when(F.col("event_id") % 37 == 0, F.lit("x")).otherwise(F.col("fingerprint")))
    return T.version_diff(T.read_version(v, 6), T.read_version(new, 8)).groupBy("change").agg(F.count("*").alias("events"))


def commit_segments(spark, d):
    v = _versions(spark, d)
    return T.commit_segments(v, 1 + (v.agg(F.max("version")).first()[0] or 0))


def outbox(spark, d):
    return T.outbox(_versions(spark, d))


def outbox_contiguity(spark, d):
    """Segments follow each other and ids are unique: one row of checks."""
    from pyspark.sql import Window

    seg = _versions(spark, d).groupBy("version").agg(F.count("*").alias("n"))
    w = Window.orderBy("version")  # a row for each segment
    gaps = seg.withColumn("gap", F.coalesce(F.col("version") - F.lag("version").over(w) != 2, F.lit(False))).agg(F.count("*").alias("segments"), F.count(F.when(F.col("gap"), 1)).alias("gaps"))
    ids = T.outbox(_versions(spark, d)).agg(F.count("*").alias("events"), (F.count("*") - F.countDistinct("ready_event_id")).alias("repeated_ids"))
    return gaps.crossJoin(ids)  # one row each


def ready_envelopes(spark, d):
    return T.ready_envelope(T.outbox(_versions(spark, d))).select("ready_event_id", "json", "bytes")


def _acks(out):
    return out.where("event_id % 7 <> 3").select("ready_event_id", "event_id")


def publish_pending(spark, d):
    out = T.outbox(_versions(spark, d))
    return T.pending(out, _acks(out), 100).select("ready_event_id", "event_id", "first_version")


def _deliveries(spark, d):
    """What a broker holds: acknowledged notifications, every eleventh of them twice, every 77th with another payload."""
    out = T.outbox(_versions(spark, d))
    a = _acks(out).select("ready_event_id", "event_id", (F.col("event_id") % 3).cast("int").alias("partition"), F.col("event_id").alias("offset"), F.lit("p").alias("payload"))
    b = a.where("event_id % 11 = 0").withColumns({"offset": F.col("offset") + 1_000_000_000, "payload": F.when(F.col("event_id") % 77 == 0, "q").otherwise(F.col("payload"))})
    return a.unionByName(b)


def receipts(spark, d):
    return T.receipts(_deliveries(spark, d))


def transport_reconcile(spark, d):
    out = T.outbox(_versions(spark, d))
    return T.transport_reconcile(out, _acks(out), _deliveries(spark, d).where("event_id % 13 <> 5"))


def offset_acceptance(spark, d):
    log = E.transaction_log(_tx(spark, d)).where("not redelivered and event_id % 999 <> 500").select(F.lit(0).alias("partition"), F.col("event_id").alias("offset"))
    return T.offset_gaps(log.unionByName(log.where("offset < 300").withColumn("partition", F.lit(1))))


def replay_plan(spark, d):
    return T.replay_plan(E.predictions(_tx(spark, d)), "candidate-1")


def delivery_outcomes(spark, d):
    p = T.replay_plan(E.predictions(_tx(spark, d)), "candidate-1")
    a = p.select("request_id", F.col("replay_sequence").alias("sequence"), F.lit("ok").alias("payload"))
    b = p.where("event_id % 9 = 0").select("request_id", (F.col("replay_sequence") + 1_000_000_000).alias("sequence"), F.when(F.col("event_id") % 27 == 0, "other").otherwise("ok").alias("payload"))
    return T.first_delivery(a.unionByName(b)).groupBy("status", "payload").agg(F.count("*").alias("requests"), F.sum("deliveries").cast("long").alias("deliveries"))


def shadow_status_counts(spark, d):
    p = E.predictions(_tx(spark, d))
    q = p.select("currency", (F.col("event_id") % 5 != 0).alias("in_scope"), (F.col("event_id") % 7 != 0).alias("input_valid"), F.when(F.col("event_id") % 11 != 0, F.col("p")).alias("p"))
    return T.shadow_status(q).groupBy("currency", "execution_status").agg(F.count("*").alias("requests"))


def parity_report(spark, d):
    p = E.predictions(_tx(spark, d)).select("event_id", "p")
    other = p.where("event_id % 301 <> 0").withColumn("p", F.when(F.col("event_id") % 97 == 0, F.col("p") + 0.25).otherwise(F.col("p")))
    extra = p.where("event_id % 401 = 0").withColumn("event_id", -F.col("event_id") - 1)
    return T.parity(p, other.unionByName(extra))


def shadow_progress(spark, d):
    out = T.outbox(_versions(spark, d))
    acc = _deliveries(spark, d)
    return T.progress(16, 20, out, acc, _acks(out).where("event_id % 2 = 0"), 1_000_000)


def publication_gate(spark, d):
    b = _versions(spark, d).groupBy((F.col("version") / 4).cast("long").alias("batch")).agg(F.count("*").alias("events"))
    return T.publication_gate(b.withColumns({"accepted": F.col("batch") < 2, "active": F.col("batch") == 2}), 100, 5000)


def shadow_reconcile(spark, d):
    out = T.outbox(_versions(spark, d))
    return T.stage_reconcile({"prepared": out, "accepted": _acks(out), "results": _acks(out).where("event_id % 2 = 0")}, "ready_event_id")


def stage_reconcile(spark, d):
    tx = _tx(spark, d)
    return T.stage_reconcile({"plan": tx.select("event_id"), "validated": tx.where("event_id % 50 <> 7"), "deduplicated": E.transaction_log(tx).where("event_id % 50 <> 7"), "statistical": tx.where("event_id % 50 not in (7, 8)").unionByName(tx.where("event_id = 1").withColumn("event_id", F.lit(-5).cast("long")))})


def stage_missing_unexpected(spark, d):
    tx = _tx(spark, d)
    a, b = tx.where("event_id % 50 <> 7").select("event_id"), tx.where("event_id % 30 <> 4").select("event_id")
    return a.exceptAll(b).select("event_id", F.lit("missing").alias("what")).unionByName(b.subtract(a).select("event_id", F.lit("unexpected").alias("what")))


def set_equality(spark, d):
    tx = _tx(spark, d)
    return T.set_equal(tx.where("event_id % 50 <> 7"), E.transaction_log(tx).where("event_id % 30 <> 4"), "event_id")


def wave_intersection(spark, d):
    tx = _tx(spark, d)
    c = [tx.where(f"wave = {w}").select("customer_id") for w in (0, 1, 2)]
    return c[0].intersect(c[1]).intersect(c[2])


def wave_cumulative(spark, d):
    tx = _tx(spark, d)
    a, b = tx.where("wave = 0").select("customer_id", "currency"), tx.where("wave = 1").select("customer_id", "currency")
    return a.unionByName(b).distinct()


def event_trace(spark, d):
    tx = _tx(spark, d)
    log = X.first_occurrence(E.transaction_log(tx)).select("event_id", F.col("kafka_offset").alias("dedup_offset"))
    roll = X.rolling(tx, 6 * E.HOUR_US, 24 * E.HOUR_US).select("event_id", "prior_transaction_count_5m", "prior_amount_sum_10m")
    stat = featured(spark, d).select("event_id", "prior_amount_observation_count", "statistical_feature_status")
    return tx.select("event_id", "customer_id", "kafka_offset").join(log, "event_id").join(roll, "event_id").join(stat, "event_id")


def retention_check(spark, d):
    v = _versions(spark, d).select("event_id", (F.col("version") / 2).cast("long").alias("commit"))
    g = v.groupBy("commit").agg(F.count("*").alias("rows"))
    return g.agg(F.count("*").alias("commits"), F.min("commit").alias("first_commit"), F.max("commit").alias("last_commit"), (F.max("commit") - F.min("commit") + 1 == F.count("*")).alias("complete"))


def notification_resolution(spark, d):
    """Notifications to the exact source row of their version and fingerprint."""
    out = T.outbox(_versions(spark, d)).withColumn("fingerprint", F.when(F.col("event_id") % 61 == 0, F.lit("stale")).otherwise(F.col("fingerprint")))
    src = _versions(spark, d).select("event_id", F.col("version").alias("first_version"), "fingerprint", F.lit(1).alias("found"))
    return out.join(src, ["event_id", "first_version", "fingerprint"], "left").groupBy("first_version").agg(F.count("*").alias("notifications"), F.count("found").alias("resolved"))


def archive_parity(spark, d):
    """Archived probabilities of each split against recomputed ones."""
    p = E.predictions(_tx(spark, d)).withColumn("split", F.when(F.col("ingestion_us") < day(12), "train").otherwise("test"))
    arch = p.where("event_id % 10 <> 3").select("split", "event_id", F.when(F.col("event_id") % 500 == 1, F.col("p") + 1e-9).otherwise(F.col("p")).alias("q"))
    return p.join(arch, ["split", "event_id"]).groupBy("split").agg(F.count("*").alias("compared"), F.count(F.when(F.abs(F.col("p") - F.col("q")) > 1e-12, 1)).alias("mismatches"))


def prediction_window(spark, d):
    """Rows before, in and after the scoring window."""
    t = F.col("ingestion_us")
    where = F.when(t < day(12), "before").when(t < day(25), "inside").otherwise("after")
    return E.predictions(_tx(spark, d)).groupBy(where.alias("position")).agg(F.count("*").alias("rows"), F.round(F.avg("p") + 1e-9, 6).alias("mean_p"))


def row_fingerprints(spark, d):
    from ..functions.canonical import digest

    return _tx(spark, d).select("event_id", digest(F.col("event_id"), F.col("customer_id"), F.col("event_us"), F.col("amount"), F.col("currency")).alias("fingerprint"))


def workload_observation(spark, d):
    tx = _tx(spark, d)
    per = tx.groupBy("customer_id").agg(F.count("*").alias("n"))
    a = tx.agg(F.count("*").alias("events"), F.countDistinct("customer_id").alias("customers"), F.countDistinct("customer_id", "currency").alias("state_keys"))
    return a.crossJoin(per.agg(F.max("n").alias("max_events"), F.round(F.percentile("n", F.lit(0.5)) + 1e-9, 6).alias("median_events")))  # one row each


def partition_imbalance(spark, d):
    g = _tx(spark, d).groupBy("kafka_partition").agg(F.count("*").alias("n"), F.countDistinct("customer_id").alias("c"))
    return g.agg(F.max("n").alias("max_records"), F.min("n").alias("min_records"), F.max("c").alias("max_customers"), F.round(F.max("n").cast("double") / F.avg("n") + 1e-9, 6).alias("imbalance"))


def prior_count_histogram(spark, d):
    return featured(spark, d).groupBy("prior_transaction_count_5m").agg(F.count("*").alias("rows"))


def null_counts(spark, d):
    f = featured(spark, d)
    return f.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in ("prior_amount_mean", "prior_amount_stddev", "amount_zscore")])


def state_continuity_examples(spark, d):
    """Per key: last event of wave 0 and first of wave 1 against a 24 h deadline and wave 0's watermark."""
    tx = _tx(spark, d)
    wm = tx.where("wave = 0").agg((F.max("event_us") - 600_000_000).alias("watermark"))
    last = tx.where("wave = 0").groupBy("customer_id", "currency").agg(F.max("event_us").alias("last_us"), F.count("*").alias("earlier"))
    first = tx.where("wave = 1").groupBy("customer_id", "currency").agg(F.min_by("event_us", "kafka_offset").alias("next_us"), F.min_by("event_id", "kafka_offset").alias("next_id"))
    d2 = last.join(first, ["customer_id", "currency"]).crossJoin(F.broadcast(wm))
    return d2.select("customer_id", "currency", "last_us", "next_us", "next_id", "earlier", F.when(F.col("last_us") + DAY_US > F.col("watermark"), "RETAINED").when(F.col("last_us") + DAY_US < F.col("watermark"), "EXPIRED").otherwise("BOUNDARY").alias("state"))


def timing_summary(spark, d):
    """Samples, least, median and greatest seconds per stage (lags of arrival stand for stage times here)."""
    lag = (F.col("ingestion_us") - F.col("event_us")).cast("double") / 1e6
    return _tx(spark, d).groupBy(F.concat(F.lit("wave-"), F.col("wave").cast("string")).alias("stage")).agg(F.count("*").alias("samples"), F.min(lag).alias("minimum"), F.percentile(lag, F.lit(0.5)).alias("median"), F.max(lag).alias("maximum"))


# The promotion requirements, in order; the first three are technical integrity.
REQUIREMENTS = ["VAL001_ARTIFACT_INTEGRITY", "VAL002_MODEL_RECONSTRUCTION", "VAL003_DATASET_PROVENANCE", "VAL004_REAL_WORLD_LABEL_QUALITY", "VAL005_TEMPORAL_GENERALIZATION", "VAL006_MODEL_DISCRIMINATION", "VAL007_PROBABILITY_CALIBRATION", "VAL008_SEGMENT_ROBUSTNESS", "VAL009_OPERATIONAL_VALIDATION", "VAL010_BUSINESS_GOVERNANCE"]
STATES = ["VERIFIED"] * 3 + ["NOT_ESTABLISHED", "NOT_ESTABLISHED", "FAILED"] + ["NOT_ESTABLISHED"] * 4


def validation_policy(spark, d):
    """Mandatory requirements that are not verified block; nothing here can make a model eligible."""
    facts = spark.createDataFrame([(i, r, s) for i, (r, s) in enumerate(zip(REQUIREMENTS, STATES, strict=True))], "position int, requirement string, status string")
    blocks = F.col("status") != "VERIFIED"
    return facts.agg(
        F.count("*").alias("requirements"),
        F.count(F.when(blocks, 1)).alias("blocking"),
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == "NOT_ESTABLISHED", F.struct("position", "requirement")))), lambda x: x["requirement"])).alias("missing_evidence"),
        (F.count(F.when((F.col("position") < 3) & blocks, 1)) == 0).alias("technical_integrity_verified"),
        F.lit("NOT_ELIGIBLE_FOR_PROMOTION").alias("readiness"),
        F.lit(False).alias("production_eligible"),
    )


RUNS = [("v1", "ds1", "split-a", "fp1", 0.11, 0.45), ("v2", "ds1", "split-b", "fp1", 0.14, 0.52), ("v3", "ds2", "split-b", "fp2", 0.12, 0.58)]


def registry_compare(spark, d):
    """Every later version against the one before, with warnings where datasets or splits differ."""
    r = spark.createDataFrame(RUNS, "version string, dataset string, split string, fingerprint string, ap double, auc double")
    a, b = r.alias("a"), r.alias("b")
    number = lambda c: F.substring(c, 2, 18).cast("long")
    j = a.join(b, number("b.version") > number("a.version"))
    warn = F.concat_ws(",", F.when(F.col("a.dataset") != F.col("b.dataset"), "DATASET_DIFFERS"), F.when(F.col("a.split") != F.col("b.split"), "SPLIT_DIFFERS"))
    return j.select(F.col("a.version").alias("left_version"), F.col("b.version").alias("right_version"), F.round(F.col("b.ap") - F.col("a.ap") + 1e-9, 6).alias("ap_change"), F.round(F.col("b.auc") - F.col("a.auc") + 1e-9, 6).alias("auc_change"), warn.alias("warnings"))


def registry_eligibility(spark, d):
    """Conjunction of manifest facts; production eligibility is never granted."""
    rows = [("c1", True, True, 0, 2393, "synthetic"), ("c2", True, False, 0, 10, "synthetic"), ("c3", True, True, 1, 10, "synthetic"), ("c4", True, True, 0, 0, "synthetic"), ("c5", True, True, 0, 5, "live")]
    m = spark.createDataFrame(rows, "candidate string, contract_ok boolean, verified boolean, mismatches long, compared long, origin string")
    ok = F.col("contract_ok") & F.col("verified") & (F.col("mismatches") == 0) & (F.col("compared") > 0) & (F.col("origin") == "synthetic")
    return m.select("candidate", ok.alias("research_eligible"), F.lit(False).alias("production_eligible"))


EDGES = [("ledger", "model"), ("model", "dataset"), ("dataset", "features"), ("dataset", "labels"), ("features", "validated"), ("drift", "ledger"), ("outcomes", "ledger"), ("outcomes", "labels"), ("x", "y"), ("y", "z"), ("z", "x")]


def lineage_closure(spark, d):
    return T.closure(spark, spark.createDataFrame(EDGES, "src string, dst string"), "outcomes")


def lineage_cycles(spark, d):
    return T.cycle_nodes(spark, spark.createDataFrame(EDGES, "src string, dst string"))


def corpus_manifest(spark, d):
    return G.manifest(G.scenario_corpus(spark, 3000, seed=7))


def corpus_profiles(spark, d):
    return G.scenario_corpus(spark, 3000, seed=7).groupBy("wave", "latent_profile", "currency").agg(F.count("*").alias("events"), F.sum("amount").cast("decimal(38,4)").alias("amount"))


def wave_ranges(spark, d):
    return _tx(spark, d).groupBy("wave").agg(F.count("*").alias("events"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.min("event_us").alias("first_us"), F.max("event_us").alias("last_us"))


def export_check(spark, d):
    out = T.outbox(_versions(spark, d))
    return T.export_check(T.ready_envelope(out).join(out.select("ready_event_id", "first_version"), "ready_event_id"), "first_version", 480, 4096)


def fence_continuity(spark, d):
    b = _tx(spark, d).groupBy(F.col("kafka_partition").alias("partition"), F.col("wave").alias("batch")).agg(F.min("kafka_offset").alias("start_offset"), (F.max("kafka_offset") + 1).alias("end_offset"))
    return T.fence_gaps(b)


def recovery_check(spark, d):
    tx = _tx(spark, d).select("event_id", "customer_id", "amount")
    return T.recovery_check(tx, tx.orderBy(F.desc("event_id")))


def observation_compare(spark, d):
    f = featured(spark, d)
    return T.compare_counts(f.where("wave = 0"), f.where("wave = 2"), "statistical_feature_status")


def delivery_caps(spark, d):
    """A bounded delivery: the cap fails, it never cuts."""
    return T.require_at_most(_versions(spark, d).where("version <= 4"), 5000, "ready events").groupBy("version").agg(F.count("*").alias("events"))


def lineitem_currency_flow(spark, d):
    """Exact decimal flow by order month and segment over the largest table: scan, two joins, one aggregate."""
    li = E.read(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice").cast("decimal(18,4)")).alias("amount"), "l_returnflag")
    o = E.read(spark, d, "orders").select("o_orderkey", "o_custkey", F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM").alias("month"))
    c = E.read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).groupBy("month", "c_mktsegment", "l_returnflag").agg(F.count("*").alias("lines"), F.sum("amount").cast("decimal(38,4)").alias("amount"))


_V = f"{with_views('versions')}, fv as (select event_id, min(version) as first_version, arg_min(fingerprint, version) as fingerprint from versions group by 1), ob as (select event_id, first_version, fingerprint, sha256(first_version || '|features|' || event_id || '|' || fingerprint) as ready_event_id, row_number() over (partition by first_version order by event_id) - 1 as position from fv)"
_ACK = "ak as (select * from ob where event_id % 7 <> 3)"
_DEL = """dl as (select ready_event_id, event_id, cast(event_id % 3 as integer) as "partition", event_id as "offset", 'p' as payload from ak union all select ready_event_id, event_id, cast(event_id % 3 as integer), event_id + 1000000000, case when event_id % 77 = 0 then 'q' else 'p' end from ak where event_id % 11 = 0)"""
_PLAN = "rp as (select event_id, sha256('candidate-1|' || event_id) as request_id, row_number() over (order by ingestion_us, event_id) - 1 as replay_sequence from predictions{})"
_VALUES = lambda rows: ", ".join("(" + ", ".join("'" + v + "'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)

QUERIES = {
    "versioned_read": (versioned_read, f"{with_views('versions')} select version, count(*) as rows, min(event_id) as first_id, max(event_id) as last_id from versions where version <= 10 group by 1"),
    "version_history": (version_history, f"{with_views('versions')} select version, 'WRITE' as operation, count(*) as rows from versions group by 1 order by 1 desc limit 20"),
    "first_visible": (first_visible, f"{_V} select * from fv"),
    "version_diff": (version_diff, f"""{with_views('versions')}, a as (select * from versions where version <= 6), b as (select event_id, version, case when event_id % 37 = 0 then 'x' else fingerprint end as fingerprint from versions where version <= 8 and event_id % 101 <> 0)
 select case when a.fingerprint is null then 'ADDED' when b.fingerprint is null then 'REMOVED' when a.fingerprint <> b.fingerprint then 'CHANGED' else 'SAME' end as change, count(*) as events from a full join b using (event_id) group by 1"""),
    "commit_segments": (commit_segments, f"{with_views('versions')}, g as (select r.version, count(v.event_id) as added from (select unnest(range(0, (select max(version) + 2 from versions))) as version) r left join versions v on v.version = r.version group by 1) select version, added, cast(sum(added) over (order by version) as bigint) as visible, cast(sum(added) over (order by version) - added as bigint) as visible_before from g"),
    "outbox": (outbox, f"{_V} select * from ob"),
    "outbox_contiguity": (outbox_contiguity, f"{_V}, g as (select version, version - lag(version) over (order by version) as step from (select distinct version from versions)) select (select count(*) from g) as segments, (select count(*) from g where step <> 2) as gaps, count(*) as events, count(*) - count(distinct ready_event_id) as repeated_ids from ob"),
    "ready_envelopes": (ready_envelopes, f"""{_V}, j as (select ready_event_id, '{{"availability_contract_version":"feature-ready-v1","availability_state":"READY","event_id":"' || event_id || '","first_visible_delta_version":' || first_version || ',"ready_event_id":"' || ready_event_id || '","source_delta_table_id":"features","source_feature_row_fingerprint":"' || fingerprint || '"}}' as json from ob) select ready_event_id, json, cast(strlen(json) + 1 as bigint) as bytes from j"""),
    "publish_pending": (publish_pending, f"{_V} select ready_event_id, event_id, first_version from ob where event_id % 7 = 3 order by first_version, event_id limit 100"),
    "receipts": (receipts, f"""{_V}, {_ACK}, {_DEL} select ready_event_id, arg_min("partition", "offset") as "partition", min("offset") as "offset", count(*) as deliveries, count(*) - 1 as duplicates, count(distinct payload) = 1 as consistent from dl group by 1"""),
    "transport_reconcile": (transport_reconcile, f"""{_V}, {_ACK}, {_DEL}, rc as (select ready_event_id, count(*) as n from dl where event_id % 13 <> 5 group by 1) select count(*) as prepared, count(ak.event_id) as acknowledged, count(n) as received, cast(sum(n) as bigint) as physical, cast(sum(n) - count(n) as bigint) as duplicates,
 count(case when ak.event_id is null then 1 end) as unacknowledged, count(case when ak.event_id is not null and n is null then 1 end) as unreceived, cast(0 as bigint) as unexpected from ob left join ak using (ready_event_id) left join rc using (ready_event_id)"""),
    "offset_acceptance": (offset_acceptance, f"""{with_views()}, l as (select 0 as part, event_id as off from tx where event_id % 999 <> 500), u as (select * from l union all select 1, off from l where off < 300) select part as "partition", min(off) as first_offset, max(off) as last_offset, count(distinct off) as offsets, max(off) - min(off) + 1 = count(distinct off) as contiguous from u group by 1"""),
    "replay_plan": (replay_plan, f"{with_views('predictions')}, {_PLAN.format('')} select * from rp"),
    "delivery_outcomes": (delivery_outcomes, f"""{with_views('predictions')}, {_PLAN.format('')}, dv as (select request_id, replay_sequence as sequence, 'ok' as payload from rp union all select request_id, replay_sequence + 1000000000, case when event_id % 27 = 0 then 'other' else 'ok' end from rp where event_id % 9 = 0),
 g as (select request_id, arg_min(payload, sequence) as payload, count(*) as n, count(distinct payload) as k from dv group by 1) select case when k > 1 then 'CONFLICT' when n > 1 then 'REPEATED' else 'DELIVERED' end as status, payload, count(*) as requests, cast(sum(n) as bigint) as deliveries from g group by 1, 2"""),
    "shadow_status_counts": (shadow_status_counts, f"{with_views('predictions')} select currency, case when event_id % 5 = 0 then 'OUT_OF_SCOPE' when event_id % 7 = 0 then 'INPUT_REJECTED' when event_id % 11 = 0 then 'INFERENCE_FAILED' else 'SCORED' end as execution_status, count(*) as requests from predictions group by 1, 2"),
    "parity_report": (parity_report, f"""{with_views('predictions')}, b as (select event_id, case when event_id % 97 = 0 then p + 0.25::double else p end as q from predictions where event_id % 301 <> 0 union all select -event_id - 1, p from predictions where event_id % 401 = 0)
 select count(abs(p - q)) as compared, count(case when q is null then 1 end) as missing, count(case when p is null then 1 end) as unexpected, count(case when abs(p - q) > 1e-12 then 1 end) as mismatched, {_r('max(abs(p - q))')} as max_absolute, {_r('max(case when p <> 0 then abs(p - q) / abs(p) end)')} as max_relative from (select event_id, p from predictions) a full join b using (event_id)"""),
    "shadow_progress": (shadow_progress, f"""{_V}, {_ACK}, {_DEL} select (select count(*) from ob) - (select count(*) from ak) as transport_backlog, (select count(*) from ak where event_id % 2 = 1) as inference_backlog, (select count(*) from ob) as prepared, (select count(*) from ak) as accepted, (select count(*) from ak where event_id % 2 = 0) as completed,
 (select count(*) from dl) - (select count(*) from ak) as duplicate_notifications, cast(4 as bigint) as discovery_backlog, 'PROCESSING' as state"""),
    "publication_gate": (publication_gate, f"""{with_views('versions')}, b as (select version // 4 as batch, count(*) as events, version // 4 < 2 as accepted, version // 4 = 2 as active from versions group by all) select batch, events, accepted, active, case when accepted then 'ALREADY_ACCEPTED' when batch <> (select min(batch) from b where not accepted) then 'NOT_EARLIEST' when active and 100 + events <= 5000 then 'AUTHORISED' when active then 'PAUSED_BACKPRESSURE' else 'OTHER_ACTIVE' end as decision from b"""),
    "shadow_reconcile": (shadow_reconcile, f"""{_V}, {_ACK} select stage, rows, rows as distinct_keys, (select count(*) from ob) - rows as missing, cast(0 as bigint) as unexpected from (select 'prepared' as stage, count(*) as rows from ob union all select 'accepted', count(*) from ak union all select 'results', count(*) from ak where event_id % 2 = 0)"""),
    "stage_reconcile": (stage_reconcile, f"""{with_views('tx_log')}, s as (select 'plan' as stage, event_id from tx union all select 'validated', event_id from tx where event_id % 50 <> 7 union all select 'deduplicated', event_id from tx_log where event_id % 50 <> 7 union all select 'statistical', event_id from tx where event_id % 50 not in (7, 8) union all select 'statistical', -5 from tx where event_id = 1)
 select stage, count(*) as rows, count(distinct event_id) as distinct_keys, (select count(*) from tx) - count(distinct case when event_id >= 0 then event_id end) as missing, count(distinct case when event_id < 0 then event_id end) as unexpected from s group by 1"""),
    "stage_missing_unexpected": (stage_missing_unexpected, f"{with_views()} select event_id, 'missing' as what from tx where event_id % 50 <> 7 and event_id % 30 = 4 union all select event_id, 'unexpected' from tx where event_id % 50 = 7 and event_id % 30 <> 4"),
    "set_equality": (set_equality, f"{with_views()} select count(case when event_id % 50 <> 7 and event_id % 30 = 4 then 1 end) as only_left, count(case when event_id % 50 = 7 and event_id % 30 <> 4 then 1 end) as only_right, count(case when event_id % 50 <> 7 and event_id % 30 <> 4 then 1 end) as both from tx"),
    "wave_intersection": (wave_intersection, f"{with_views()} select customer_id from tx group by 1 having count(distinct wave) = 3"),
    "wave_cumulative": (wave_cumulative, f"{with_views()} select distinct customer_id, currency from tx where wave in (0, 1)"),
    "event_trace": (event_trace, f"{_FEAT} select event_id, customer_id, kafka_offset, kafka_offset as dedup_offset, prior_transaction_count_5m, prior_amount_sum_10m, prior_amount_observation_count, statistical_feature_status from stat"),
    "retention_check": (retention_check, f"{with_views('versions')} select count(distinct version // 2) as commits, min(version // 2) as first_commit, max(version // 2) as last_commit, max(version // 2) - min(version // 2) + 1 = count(distinct version // 2) as complete from versions"),
    "notification_resolution": (notification_resolution, f"{_V} select first_version, count(*) as notifications, count(case when event_id % 61 <> 0 then 1 end) as resolved from ob group by 1"),
    "archive_parity": (archive_parity, f"{with_views('predictions')} select case when ingestion_us < {day(12)} then 'train' else 'test' end as split, count(*) as compared, count(case when event_id % 500 = 1 then 1 end) as mismatches from predictions where event_id % 10 <> 3 group by 1"),
    "prediction_window": (prediction_window, f"{with_views('predictions')} select case when ingestion_us < {day(12)} then 'before' when ingestion_us < {day(25)} then 'inside' else 'after' end as position, count(*) as rows, {_r('avg(p)')} as mean_p from predictions group by 1"),
    "row_fingerprints": (row_fingerprints, f"{with_views()} select event_id, sha256(event_id || '|' || customer_id || '|' || event_us || '|' || amount || '|' || currency) as fingerprint from tx"),
    "workload_observation": (workload_observation, f"{with_views()}, g as (select customer_id, count(*) as n from tx group by 1) select (select count(*) from tx) as events, (select count(distinct customer_id) from tx) as customers, (select count(*) from (select distinct customer_id, currency from tx)) as state_keys, max(n) as max_events, {_r('quantile_cont(n, 0.5)')} as median_events from g"),
    "partition_imbalance": (partition_imbalance, f"{with_views()}, g as (select kafka_partition, count(*) as n, count(distinct customer_id) as c from tx group by 1) select max(n) as max_records, min(n) as min_records, max(c) as max_customers, {_r('cast(max(n) as double) / avg(n)')} as imbalance from g"),
    "prior_count_histogram": (prior_count_histogram, f"{_FEAT} select prior_transaction_count_5m, count(*) as rows from stat group by 1"),
    "null_counts": (null_counts, f"{_FEAT} select count(*) - count(prior_amount_mean) as prior_amount_mean, count(*) - count(prior_amount_stddev) as prior_amount_stddev, count(*) - count(amount_zscore) as amount_zscore from stat"),
    "state_continuity_examples": (state_continuity_examples, f"""{with_views()}, l as (select customer_id, currency, max(event_us) as last_us, count(*) as earlier from tx where wave = 0 group by 1, 2), f as (select customer_id, currency, arg_min(event_us, kafka_offset) as next_us, arg_min(event_id, kafka_offset) as next_id from tx where wave = 1 group by 1, 2),
 w as (select max(event_us) - 600000000 as watermark from tx where wave = 0) select customer_id, currency, last_us, next_us, next_id, earlier, case when last_us + {DAY_US} > watermark then 'RETAINED' when last_us + {DAY_US} < watermark then 'EXPIRED' else 'BOUNDARY' end as state from l join f using (customer_id, currency), w"""),
    "timing_summary": (timing_summary, f"{with_views()} select 'wave-' || wave as stage, count(*) as samples, min((ingestion_us - event_us) / 1e6::double) as minimum, quantile_cont((ingestion_us - event_us) / 1e6::double, 0.5) as median, max((ingestion_us - event_us) / 1e6::double) as maximum from tx group by 1"),
    "validation_policy": (validation_policy, f"with f(position, requirement, status) as (values {_VALUES([(i, r, s) for i, (r, s) in enumerate(zip(REQUIREMENTS, STATES, strict=True))])}) select count(*) as requirements, count(case when status <> 'VERIFIED' then 1 end) as blocking, string_agg(case when status = 'NOT_ESTABLISHED' then requirement end, ',' order by position) as missing_evidence, count(case when position < 3 and status <> 'VERIFIED' then 1 end) = 0 as technical_integrity_verified, 'NOT_ELIGIBLE_FOR_PROMOTION' as readiness, false as production_eligible from f"),
    "registry_compare": (registry_compare, f"with r(version, dataset, split, fingerprint, ap, auc) as (values {_VALUES(RUNS)}) select a.version as left_version, b.version as right_version, {_r('cast(b.ap as double) - cast(a.ap as double)')} as ap_change, {_r('cast(b.auc as double) - cast(a.auc as double)')} as auc_change, concat_ws(',', case when a.dataset <> b.dataset then 'DATASET_DIFFERS' end, case when a.split <> b.split then 'SPLIT_DIFFERS' end) as warnings from r a join r b on b.version > a.version"),
    "registry_eligibility": (registry_eligibility, "select * from (values ('c1', true, false), ('c2', false, false), ('c3', false, false), ('c4', false, false), ('c5', false, false)) as t(candidate, research_eligible, production_eligible)"),
    "lineage_closure": (lineage_closure, f"with recursive e(src, dst) as (values {_VALUES(EDGES)}), c as (select 'outcomes' as node, 0 as depth union select dst, depth + 1 from c join e on src = node) select node, cast(min(depth) as integer) as depth from c group by 1"),
    "lineage_cycles": (lineage_cycles, f"with recursive e(src, dst) as (values {_VALUES(EDGES)}), c as (select src, dst from e union select c.src, e.dst from c join e on e.src = c.dst) select distinct src as node from c where src = dst"),
    "corpus_manifest": (corpus_manifest, G.MANIFEST_SQL.format(n=3000, seed=7)),
    "corpus_profiles": (corpus_profiles, G.PROFILES_SQL.format(n=3000, seed=7)),
    "wave_ranges": (wave_ranges, f"{with_views()} select wave, count(*) as events, min(event_id) as first_id, max(event_id) as last_id, min(event_us) as first_us, max(event_us) as last_us from tx group by 1"),
    "export_check": (export_check, f"{_V}, b as (select first_version, count(*) as events, max(cast(strlen('{{\"availability_contract_version\":\"feature-ready-v1\",\"availability_state\":\"READY\",\"event_id\":\"' || event_id || '\",\"first_visible_delta_version\":' || first_version || ',\"ready_event_id\":\"' || ready_event_id || '\",\"source_delta_table_id\":\"features\",\"source_feature_row_fingerprint\":\"' || fingerprint || '\"}}') + 1 as bigint)) as largest from ob group by 1) select *, events <= 480 and largest <= 4096 as exportable from b"),
    "fence_continuity": (fence_continuity, f"""{with_views()}, b as (select kafka_partition as part, wave as batch, min(kafka_offset) as start_offset, max(kafka_offset) + 1 as end_offset from tx group by 1, 2), g as (select *, coalesce(start_offset - lag(end_offset) over (partition by part order by batch), 0) as gap from b)
 select part as "partition", batch, start_offset, end_offset, gap, case when gap = 0 then 'CONTIGUOUS' when gap > 0 then 'GAP' else 'OVERLAP' end as fence from g"""),
    "recovery_check": (recovery_check, f"{with_views()} select count(*) as rows_before, count(*) as rows_after, true as unchanged from tx"),
    "observation_compare": (observation_compare, f"{_FEAT} select statistical_feature_status, count(case when wave = 0 then 1 end) as left_rows, count(case when wave = 2 then 1 end) as right_rows, count(case when wave = 2 then 1 end) - count(case when wave = 0 then 1 end) as change from stat where wave in (0, 2) group by 1"),
    "delivery_caps": (delivery_caps, f"{with_views('versions')} select version, count(*) as events from versions where version <= 4 group by 1"),
    "lineitem_currency_flow": (lineitem_currency_flow, "select strftime(o_orderdate, '%Y-%m') as month, c_mktsegment, l_returnflag, count(*) as lines, cast(sum(cast(l_extendedprice as decimal(18,4))) as decimal(38,4)) as amount from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1, 2, 3"),
}
