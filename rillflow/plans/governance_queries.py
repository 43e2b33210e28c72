"""Candidates, policies, snapshots, graphs, files, artifacts and recovery as queries, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import artifacts as A
from ..operators import features as X
from ..operators import governance as V
from ..operators import modelling as ML
from ..operators import transport as T
from ..sources import events as E
from ..sources import generator as G
from ..sources import readers as R
from ..sources.events import with_views
from ..sources.store import VersionedTable, sink
from ..streaming import jobs as J
from .event_queries import LONG_POLICY, featured
from .monitoring_queries import _COHORT, _r
from .stream_queries import _dataset, _root
from .transport_queries import _tx


def candidate_eligibility(spark, d):
    """A candidate for each customer; of some, a fact or a text is not what it must be."""
    c = F.col("customer_id")
    m = _tx(spark, d).groupBy("customer_id").agg(F.count("*").alias("compared"), F.count(F.when(F.col("event_id") % 401 == 7, 1)).alias("mismatches"))
    text = {n: F.concat(F.lit(f"{n}-"), c.cast("string")) for n in V.TEXTS} | {"model_tree_sha256": F.when(c % 11 == 5, F.lit(" ")).otherwise(F.lit("h"))}
    fact = {n: F.lit(v) for n, v in V.FACTS.items()} | {"validation_status": F.when(c % 7 == 3, F.lit(None)).otherwise(F.lit("TECHNICALLY_VERIFIED")), "data_origin": F.when(c % 9 == 4, "live").otherwise("synthetic")}
    more = {"candidate_contract_version": F.lit("c1"), "input_schema_fingerprint": F.lit("f1"), "serialization_format": F.lit("s1"), "positive_label": F.lit(1), "round_trip_mismatches": F.col("mismatches")}
    return V.eligibility(m.withColumns(text | fact | more), "c1", "f1", "s1")


def policy_by_candidate(spark, d):
    """Ten requirements for each customer's candidate, with states drawn from its events."""
    x = _tx(spark, d).groupBy("customer_id").agg(F.count("*").alias("n"))
    s = x.select("customer_id", "n", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("position"))
    k = (F.col("n") + F.col("position") * F.col("customer_id")) % 5
    return V.policy(s.withColumn("status", F.when(k == 0, "FAILED").when(k == 1, "NOT_ESTABLISHED").otherwise("VERIFIED")), "customer_id")


def snapshot_differences(spark, d):
    """A drift snapshot for each wave and currency; those of one currency compared wave by wave."""
    g = _tx(spark, d).groupBy("wave", "currency").agg(F.count("*").alias("n"), F.min("event_us").alias("lo"), F.max("event_id").alias("hi"))
    s = F.struct(
        F.concat("currency", F.lit("-"), F.col("wave").cast("string")).alias("snapshot"),
        F.lit("c").alias("candidate_id"),
        F.lit("w").alias("reference_window"),
        (F.col("n") % 2).alias("reference_membership"),
        F.when(F.col("wave") == 2, F.lit(None)).otherwise(1).alias("algorithm_version"),
        F.lit("i").alias("input_contract"),
        (F.col("wave") > 0).alias("metric_configuration"),
        F.lit("t").alias("source_table"),
        F.col("hi").alias("source_version"),
        F.col("lo").alias("comparison_window"),
    )
    a = g.select("currency", "wave", s.alias("a"))
    b = g.select("currency", (F.col("wave") - 1).alias("wave"), s.alias("b"))
    return V.snapshot_differences(a.join(b, ["currency", "wave"]))


def graph_errors(spark, d):
    """Customers depend on their country and country on region; some nodes are doubled, blank, absent or in a circle."""
    tx = _tx(spark, d)
    cust, c = tx.select("customer_id", "country").distinct(), F.col("customer_id")
    node = lambda i, why: (i.cast("string").alias("id"), F.lit("r").alias("role"), why.alias("reason"))
    nodes = cust.select(*node(c, F.when(c % 8 == 1, " ").otherwise("x"))).unionByName(cust.where(c % 9 == 2).select(*node(c, F.lit("x"))))
    nodes = nodes.unionByName(cust.where("country <> 'US'").select(F.col("country").alias("id"), F.lit("r").alias("role"), F.lit("x").alias("reason")).distinct())
    s = c.cast("string")
    edges = cust.select(s.alias("src"), F.col("country").alias("dst")).unionByName(cust.where(c % 10 == 3).select(s.alias("src"), s.alias("dst")))
    return V.graph_errors(nodes, edges)


def publisher_report(spark, d):
    """All transactions published to a log, of which a part is lost on the way: what was asked for and what was acknowledged."""
    root, k = _root(spark), F.col("event_id").cast("string")
    tx = _tx(spark, d)
    R.append_log(tx.where("event_id % 37 <> 5").select(k.alias("key"), F.col("amount").cast("string").alias("value"), "event_us", F.col("event_id").alias("order")), f"{root}/log", "t", 3)
    return V.publication_report(tx.select(k.alias("key"), "wave"), spark.read.parquet(f"{root}/log").select(F.col("key").cast("string").alias("key")), "wave")


def label_lines(spark, d):
    """Every label written as a JSON line and read back by the strict reader."""
    root = _root(spark)
    iso = F.date_format(F.timestamp_micros("observed_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    E.label_history(_tx(spark, d)).select(F.col("event_id").cast("string").alias("event_id"), "outcome", iso.alias("label_observed_at"), "label_source", F.col("revision").alias("label_revision")).write.json(f"{root}/labels")
    return R.labels(spark, f"{root}/labels").select(F.col("event_id").cast("long").alias("event_id"), "outcome", "observed_us", "label_source", "revision")


def corpus_lines(spark, d):
    """Every transaction as a tab-separated line, read back with header and number of fields checked."""
    root = _root(spark)
    G.write_tsv(_tx(spark, d).select("event_id", "customer_id", "event_us", "amount", "currency"), f"{root}/tsv")
    return G.read_tsv(spark, f"{root}/tsv", "event_id long, customer_id long, event_us long, amount decimal(18,4), currency string")


def artifact_rebuild(spark, d):
    """A data set published, verified, and built again from its source in another order."""
    tx, root = _tx(spark, d).select("event_id", "customer_id", "amount"), _root(spark)
    a = A.publish(tx, root, {"kind": "dataset"})
    b = A.publish(tx.orderBy(F.desc("event_id")), root, {"kind": "dataset"})
    rows = spark.read.parquet(f"{a['path']}/data").agg(F.count("*").alias("rows"), F.sum("event_id").alias("id_sum"))
    return rows.withColumns({"verified": F.lit(A.verify(spark, a)), "same_identity": F.lit(a["id"] == b["id"])})


def retried_commit(spark, d):
    """A job that dies right after its commit is run again: rows, digest and version before and after."""
    tx = _tx(spark, d).select("event_id", "customer_id", "amount")
    table = VersionedTable(spark, _root(spark), "event_id long, customer_id long, amount decimal(18,4)")

    def die(version):
        raise InterruptedError

    try:
        table.append(tx, "loader", 0, die)
    except InterruptedError:
        pass
    before = table.read()
    again = table.append(tx, "loader", 0)
    after = VersionedTable(spark, table.path, table.ddl).read()
    return T.recovery_check(before, after).withColumns({"written_again": F.lit(again is not None), "commits": F.lit(len(table.log()))})


def registry_versions(spark, d):
    """A version registered for each wave, with metrics of its predictions; each compared with the one before."""
    p = E.predictions(_tx(spark, d)).join(_tx(spark, d).select("event_id", "wave"), "event_id")
    m = p.groupBy("wave").agg(F.count("*").alias("rows"), F.avg("p").alias("mean_p")).orderBy("wave").collect()  # three rows
    registry = ML.Registry(spark, f"{_root(spark)}/registry")
    names = {r.wave: f"v{9 + r.wave}" for r in m}
    for r in m:
        registry.register(names[r.wave], "c", "ds" if r.wave < 2 else "ds2", f"split-{r.wave}", {"rows": r.rows, "mean_p": r.mean_p}, r.wave)
    pairs = [(names[a], names[b]) for a, b in zip(list(names), list(names)[1:])]
    out = spark.createDataFrame([], "left_version string, right_version string, metric string, left_value double, right_value double, change double, warnings string")
    for a, b in pairs:
        out = out.unionByName(registry.compare(a, b).withColumns({"left_version": F.lit(a), "right_version": F.lit(b)}).select(*out.columns))
    r6 = lambda c: F.round(F.col(c) + 1e-9, 6).alias(c)
    return out.select("left_version", "right_version", "metric", r6("left_value"), r6("right_value"), r6("change"), "warnings")


def archived_candidate(spark, d):
    """The baseline saved, loaded and scored again: probabilities that differ."""
    ds = _dataset(spark, d)
    return ML.reload_parity(ML.fit(ds.where("cohort = 'train'")), f"{_root(spark)}/model", ds.where("cohort in ('validation', 'test')"))


def invalid_scenarios(spark, d):
    """The named bad candidates and whether each gives its error."""
    from ..functions import validation

    x = validation.validate(G.invalid_scenarios(spark))
    return x.select("scenario", F.array_contains(F.col("errors").cast("array<string>"), F.col("expected")).alias("as_expected"))


def table_stream(spark, d):
    """A stream over a versioned table, one of whose commits is made after the stream is built: rows it brought by wave."""
    root, ddl = _root(spark), "event_id long, wave int"
    tx = _tx(spark, d).select("event_id", "wave")
    source, out = VersionedTable(spark, f"{root}/in", ddl), VersionedTable(spark, f"{root}/out", ddl)
    for w in (0, 1):
        source.append(tx.where(F.col("wave") == w), "loader", w)
    stream = source.stream()
    source.append(tx.where("wave = 2"), "loader", 2)
    J.run_available(stream, f"{root}/checkpoint", f"table-{root[-6:]}", sink(out, "copy"))
    return out.read().groupBy("wave").agg(F.count("*").alias("rows"), F.countDistinct("event_id").alias("events"))


def late_rows(spark, d):
    """Waves in the order 0, 2, 1 with a watermark of ten minutes: wave 1 is late, and the progress rows say so."""
    root = _root(spark)
    tx = _tx(spark, d).select("event_id", "event_time", "wave")
    for w in (0, 2, 1):
        tx.where(F.col("wave") == w).write.parquet(f"{root}/in/{w}")
    config = J.StreamConfig("late", watermark="10 minutes")
    out = VersionedTable(spark, f"{root}/out", "event_id long, event_time timestamp, wave int")
    rows = None
    for w in (0, 2, 1):  # a run for each, from one checkpoint
        if w != 0:
            spark.read.parquet(f"{root}/in/{w}").write.mode("append").parquet(f"{root}/in/0")
        stream = spark.readStream.schema(tx.schema).parquet(f"{root}/in/0")
        q = J.run_available(J.deduplicated(stream, config), f"{root}/checkpoint", f"late-{w}-{root[-6:]}", sink(out, "late"))
        p = J.progress_table(spark, q).agg(F.sum("input_rows").alias("input_rows"), F.sum("late_rows").alias("late_rows")).withColumn("wave", F.lit(w))
        rows = p if rows is None else rows.unionByName(p)
    kept = out.read().groupBy("wave").agg(F.count("*").alias("kept"))
    return rows.join(kept, "wave", "left").na.fill(0, ["kept"])


def risk_quarantine(spark, d):
    """Features without a status are left out of the decisions instead of failing them."""
    status = F.when(F.col("event_id") % 19 != 3, F.col("statistical_feature_status"))
    f = featured(spark, d).withColumn("statistical_feature_status", status)
    return X.decide(f, LONG_POLICY, mode="quarantine").groupBy("currency").agg(F.count("*").alias("rows"))


_FAILED = "concat_ws(',', case when customer_id % 7 = 3 then 'validation_status' end, case when customer_id % 9 = 4 then 'data_origin' end, case when m > 0 then 'mismatches' end, case when customer_id % 11 = 5 then 'model_tree_sha256' end)"
_GRAPH = "c as (select distinct customer_id as id, country from tx)"

QUERIES = {
    "candidate_eligibility": (candidate_eligibility, f"{with_views()}, g as (select customer_id, count(case when event_id % 401 = 7 then 1 end) as m from tx group by 1) select 'candidate_id-' || customer_id as candidate_id, {_FAILED} as failed, {_FAILED} = '' as research_eligible, false as production_eligible from g"),
    "policy_by_candidate": (policy_by_candidate, f"""{with_views()}, g as (select customer_id, count(*) as n from tx group by 1), s as (select customer_id, r as position, (n + r * customer_id) % 5 as k from g, (select unnest(range(0, 10)) as r))
 select customer_id, count(*) as requirements, count(case when k < 2 then 1 end) as blocking, coalesce(string_agg(case when k = 1 then position end, ',' order by position), '') as missing_evidence, count(case when k < 2 and position < 3 then 1 end) = 0 as technical_integrity_verified, 'NOT_ELIGIBLE_FOR_PROMOTION' as readiness from s group by 1"""),
    "snapshot_differences": (snapshot_differences, f"""{with_views()}, g as (select wave, currency, count(*) as n, min(event_us) as lo, max(event_id) as hi from tx group by 1, 2) select a.currency || '-' || a.wave as first_snapshot, b.currency || '-' || b.wave as second_snapshot,
 concat_ws(',', case when a.n % 2 <> b.n % 2 then 'reference_population' end, case when (a.wave = 2) <> (b.wave = 2) then 'algorithm_version' end, case when (a.wave > 0) <> (b.wave > 0) then 'metric_configuration' end, case when a.hi <> b.hi then 'delta_source' end) as warnings, a.lo <> b.lo as comparison_window_changed from g a join g b on a.currency = b.currency and b.wave = a.wave + 1"""),
    "graph_errors": (graph_errors, f"""{with_views()}, {_GRAPH} select cast(id as varchar) as node, 'REPEATED_ID' as error from c where id % 9 = 2 union all select cast(id as varchar), 'NO_ROLE_OR_REASON' from c where id % 8 = 1
 union all select cast(id as varchar), 'OPEN_EDGE' from c where country = 'US' union all select cast(id as varchar), 'CYCLE' from c where id % 10 = 3"""),
    "publisher_report": (publisher_report, f"{with_views()} select wave, count(*) as requested, count(case when event_id % 37 <> 5 then 1 end) as acknowledged, count(case when event_id % 37 = 5 then 1 end) as failed from tx group by 1"),
    "label_lines": (label_lines, f"{with_views('labels_rev')} select event_id, outcome, observed_us, label_source, revision from labels_rev"),
    "corpus_lines": (corpus_lines, f"{with_views()} select event_id, customer_id, event_us, amount, currency from tx"),
    "artifact_rebuild": (artifact_rebuild, f"{with_views()} select count(*) as rows, cast(sum(event_id) as bigint) as id_sum, true as verified, true as same_identity from tx"),
    "retried_commit": (retried_commit, f"{with_views()} select count(*) as rows_before, count(*) as rows_after, true as unchanged, false as written_again, cast(1 as integer) as commits from tx"),
    "registry_versions": (registry_versions, f"""{with_views('predictions')}, g as (select wave, cast(count(*) as double) as rows, avg(p) as mean_p from predictions join tx using (event_id) group by 1), m as (select wave, 'rows' as metric, rows as v from g union all select wave, 'mean_p', mean_p from g)
 select 'v' || (9 + a.wave) as left_version, 'v' || (9 + b.wave) as right_version, metric, {_r('a.v')} as left_value, {_r('b.v')} as right_value, {_r('b.v - a.v')} as change, case when b.wave = 2 then 'DATASET_DIFFERS,' else '' end || 'SPLIT_DIFFERS' as warnings from m a join m b using (metric) where b.wave = a.wave + 1"""),
    "archived_candidate": (archived_candidate, f"{_COHORT} select count(*) as compared, cast(0 as bigint) as mismatches from co where cohort in ('validation', 'test')"),
    "invalid_scenarios": (invalid_scenarios, "select unnest(['blank_customer', 'malformed_id', 'negative_amount', 'lower_currency', 'wire_transfer', 'future_schema', 'bad_time']) as scenario, true as as_expected"),
    "table_stream": (table_stream, f"{with_views()} select wave, count(*) as rows, count(*) as events from tx group by 1"),
    "late_rows": (late_rows, f"{with_views()} select wave, count(*) as input_rows, case when wave = 1 then count(*) else 0 end as late_rows, case when wave = 1 then 0 else count(*) end as kept from tx group by 1"),
    "risk_quarantine": (risk_quarantine, f"{with_views()} select currency, count(*) as rows from tx where event_id % 19 <> 3 group by 1"),
}
