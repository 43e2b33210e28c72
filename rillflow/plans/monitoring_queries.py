"""Labels, datasets, cohorts, quality metrics, outcomes, feedback, drift, investigation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitoring as M
from ..sources import events as E
from ..sources.events import DAY_US, EPOCH_US, with_views
from .event_queries import _FEAT, _ROLL, featured


def day(n: float) -> int:
    return EPOCH_US + int(n * DAY_US)


ASOF_1, ASOF_2 = day(20), day(60)
TRAIN, VALIDATION, TEST = day(12), day(20), day(28)
REF, COMP = (day(2), day(12)), (day(15), day(27))
FB_ASOF = day(18)


def _tx(spark, d):
    return E.transactions(spark, d)


def _labels(spark, d):
    return E.label_history(_tx(spark, d))


def _scored(spark, d):
    """Predictions with the outcome selected at the second cut-off."""
    chosen = M.labels_asof(_labels(spark, d), ASOF_2).select("event_id", (F.col("outcome") == "FRAUD").cast("int").alias("fraud_label"), "revision")
    return E.predictions(_tx(spark, d)).join(chosen, "event_id")


def labels_asof(spark, d):
    return M.labels_asof(_labels(spark, d), ASOF_1).select("event_id", "outcome", "observed_us", "label_source", "revision")


def labels_contiguity(spark, d):
    broken = _labels(spark, d).where("not (revision = 1 and event_id % 99 = 0)")
    return M.label_history_errors(broken).where("gaps > 0 or backwards > 0")


def dataset_asof(spark, d):
    out = M.dataset_asof(featured(spark, d), _labels(spark, d), ASOF_1)
    return out.select("event_id", "amount", "prior_transaction_count_5m", "statistical_feature_status", "fraud_label", "observed_us", "label_source", "revision")


def dataset_counts(spark, d):
    return M.dataset_counts(_tx(spark, d).where("event_id % 50 <> 7"), _labels(spark, d), ASOF_1)


def temporal_cohorts(spark, d):
    c = M.temporal_cohorts(M.dataset_asof(_tx(spark, d), _labels(spark, d), ASOF_2), TRAIN, VALIDATION, TEST)
    return c.groupBy("cohort", "fraud_label").agg(F.count("*").alias("rows"), F.min("ingestion_us").alias("first_us"), F.max("ingestion_us").alias("last_us"))


def class_weights(spark, d):
    return M.class_weights(M.temporal_cohorts(M.dataset_asof(_tx(spark, d), _labels(spark, d), ASOF_2), TRAIN, VALIDATION, TEST))


def cohort_quality(spark, d):
    return M.cohort_quality(_tx(spark, d), _labels(spark, d), TRAIN, VALIDATION, TEST, ASOF_2)


def confusion_at_half(spark, d):
    return M.confusion(_scored(spark, d), 0.5, "currency")


def average_precision(spark, d):
    return M.average_precision(_scored(spark, d), "currency")


def roc_auc(spark, d):
    return M.roc_auc(_scored(spark, d), "currency")


def outcome_coverage(spark, d):
    return M.outcome_coverage(E.predictions(_tx(spark, d)), _labels(spark, d), ASOF_1)


def outcome_segments(spark, d):
    return M.segment_metrics(_scored(spark, d), ["currency", "country", "transaction_type"])


def outcome_support_gate(spark, d):
    g = _scored(spark, d).groupBy("customer_id").agg(F.count("*").alias("rows"), F.sum("fraud_label").cast("long").alias("positives"))
    return g.select("customer_id", "rows", "positives", M.gate(F.col("rows"), F.col("positives"), 60, 5).alias("support"))


def outcome_compare(spark, d):
    return M.outcome_compare(E.predictions(_tx(spark, d)), _labels(spark, d), ASOF_1, ASOF_2).groupBy("change").agg(F.count("*").alias("events"))


def feedback_availability(spark, d):
    return M.feedback_available(E.feedback(_tx(spark, d))).select("provider_id", "provider_record_id", "source_revision", "available_us")


def _resolved(spark, d):
    tx = _tx(spark, d)
    fb = E.feedback(tx)
    other = fb.where("event_id % 63 = 0").select(F.lit("provider-c").alias("provider_id"), F.concat(F.lit("c-"), "provider_case_id").alias("provider_case_id"), "provider_record_id", "event_id", "source_revision", F.lit("CONFIRMED_FRAUD").alias("status"), "received_us")
    return M.feedback_resolved(tx.select("event_id", "ingestion_us", "currency"), fb.unionByName(other), FB_ASOF)


def feedback_resolved(spark, d):
    return _resolved(spark, d).select("event_id", "state", "cases")


def feedback_buckets(spark, d):
    h = (F.lit(FB_ASOF) - F.col("ingestion_us")).cast("double") / float(E.HOUR_US)
    r6 = lambda c: F.round(c + 1e-9, 6)
    return _resolved(spark, d).groupBy("state").agg(F.count("*").alias("events"), r6(F.min(h)).alias("age_min"), r6(F.percentile(h, F.lit(0.5))).alias("age_median"), r6(F.max(h)).alias("age_max"))


def feedback_quality(spark, d):
    r = _resolved(spark, d).where("state in ('FRAUD', 'LEGIT')").select("event_id", (F.col("state") == "FRAUD").cast("int").alias("fraud_label"))
    return M.confusion(E.predictions(_tx(spark, d)).join(r, "event_id"), 0.5, "country")


def feedback_ingest_checks(spark, d):
    tx = _tx(spark, d)
    broken = E.feedback(tx).where("not (source_revision = 1 and event_id % 45 = 0)").withColumn("event_id", F.when(F.col("source_revision") == 3, F.col("event_id") + 1_000_000_000).otherwise(F.col("event_id")))
    broken = broken.withColumn("received_us", F.when(F.col("event_id") % 51 == 0, F.lit(EPOCH_US - 1)).otherwise(F.col("received_us")))
    return M.feedback_errors(broken, tx)


def feedback_merge(spark, d):
    fb = E.feedback(_tx(spark, d)).select("provider_record_id", "event_id", "source_revision", "status", "received_us")
    base = fb.where("source_revision = 1")
    batch = fb.where("source_revision = 2 or event_id % 12 = 0").withColumn("status", F.when(F.col("event_id") % 36 == 0, "RETRACTED").otherwise(F.col("status")))
    return M.feedback_merge(base, batch).groupBy("resolution").agg(F.count("*").alias("records"), F.sum("deliveries").cast("long").alias("deliveries"))


FEATURES = ["amount", "prior_transaction_count_5m", "prior_amount_sum_10m", "prior_amount_observation_count", "prior_amount_mean", "prior_amount_stddev", "amount_zscore"]
CATEGORIES = ["currency", "country", "statistical_feature_status"]


def _sides(spark, d):
    return M.cohort_sides(featured(spark, d), "ingestion_us", REF, COMP)


def _long(spark, d):
    return M.unpivot(_sides(spark, d), FEATURES, "side")


def _categories(spark, d):
    s = _sides(spark, d)
    s = s.withColumn("currency", F.when((F.col("side") == "comparison") & (F.col("currency") == "GBP"), F.when(F.col("event_id") % 2 == 0, "CHF")).otherwise(F.col("currency")))
    return s.select("side", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in CATEGORIES])).alias("u")).select("side", "u.*")


def numeric_summary(spark, d):
    return M.numeric_summary(_long(spark, d), "side", "feature")


def ks_distance(spark, d):
    return M.ks_distance(_long(spark, d), "feature")


def psi(spark, d):
    return M.psi(_long(spark, d), 10, 0.5, "feature")


def psi_degenerate(spark, d):
    long = _long(spark, d).where("feature = 'amount'").withColumn("x", F.when(F.col("side") == "reference", 7.0).otherwise(F.col("x")))
    return M.psi(long, 10, 0.5, "feature")


def categorical_tvd_js(spark, d):
    return M.categorical_shift(_categories(spark, d), "feature")


def category_changes(spark, d):
    return M.category_changes(_categories(spark, d), "feature")


def _score_sides(spark, d):
    return M.cohort_sides(E.predictions(_tx(spark, d)), "ingestion_us", REF, COMP)


def score_share(spark, d):
    return _score_sides(spark, d).groupBy("side").agg(F.count("*").alias("rows"), F.round(F.avg((F.col("p") >= 0.5).cast("double")) + 1e-9, 6).alias("share"))


MONEY = ["amount", "prior_amount_sum_10m", "prior_amount_mean", "prior_amount_stddev", "amount_zscore"]


def currency_strata(spark, d):
    return M.ks_distance(M.unpivot(_sides(spark, d), MONEY, "side", "currency"), "currency", "feature")


def currency_strata_summary(spark, d):
    return M.numeric_summary(M.unpivot(_sides(spark, d), MONEY, "side", "currency"), "currency", "side", "feature")


def drift_support_gate(spark, d):
    return M.support_gate(M.unpivot(_sides(spark, d), MONEY, "side", "currency"), 500, 400, "currency", "feature")


def drift_compare(spark, d):
    """KS of the scores in two pairs of cohorts, and the change between them."""
    a = M.ks_distance(M.unpivot(_score_sides(spark, d), ["p"], "side"), "feature").select("feature", F.col("ks").alias("first_ks"))
    other = M.cohort_sides(E.predictions(_tx(spark, d)), "ingestion_us", (day(2), day(8)), (day(8), day(14)))
    b = M.ks_distance(M.unpivot(other, ["p"], "side"), "feature").select("feature", F.col("ks").alias("second_ks"))
    return a.join(b, "feature").select("feature", "first_ks", "second_ks", F.round(F.col("second_ks") - F.col("first_ks") + 1e-9, 6).alias("change"))


def investigation_findings(spark, d):
    """Findings of every kind in one shape: kind, subject, measure, value."""
    s = _sides(spark, d)
    v = lambda c: F.round(c + 1e-9, 6).cast("double").alias("value")
    pick = lambda df, kind, subject, measure, value: df.select(F.lit(kind).alias("kind"), subject.alias("subject"), F.lit(measure).alias("measure"), v(value))
    long = M.unpivot(s, FEATURES, "side")
    miss = M.numeric_summary(long, "side", "feature").where("side = 'comparison' and nulls > 0")
    cats = M.categorical_shift(s.select("side", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in CATEGORIES])).alias("u")).select("side", "u.*"), "feature")
    cov = M.outcome_coverage(E.predictions(_tx(spark, d)), _labels(spark, d), ASOF_1)
    change = M.outcome_compare(E.predictions(_tx(spark, d)), _labels(spark, d), ASOF_1, ASOF_2).groupBy("change").agg(F.count("*").alias("n")).where("change in ('FLIPPED', 'REVISED')")
    gaps = M.support_gate(M.unpivot(s, MONEY, "side", "currency"), 500, 400, "currency", "feature").where("support <> 'AVAILABLE'")
    strata = M.ks_distance(M.unpivot(s, MONEY, "side", "currency"), "currency", "feature").where("ks is not null")
    return (
        pick(miss, "MISSINGNESS", F.col("feature"), "missing_fraction", F.col("missing_fraction"))
        .unionByName(pick(M.ks_distance(long, "feature").where("ks is not null"), "FEATURE_DISTRIBUTION", F.col("feature"), "ks", F.col("ks")))
        .unionByName(pick(cats, "POPULATION_COMPOSITION", F.col("feature"), "total_variation", F.col("total_variation")))
        .unionByName(pick(M.ks_distance(M.unpivot(_score_sides(spark, d), ["p"], "side"), "feature"), "PREDICTION_DISTRIBUTION", F.col("feature"), "ks", F.col("ks")))
        .unionByName(pick(strata, "CURRENCY_STRATIFICATION", F.concat_ws("/", "currency", "feature"), "ks", F.col("ks")))
        .unionByName(pick(cov, "LABEL_COVERAGE", F.lit("scored"), "coverage", F.col("coverage")))
        .unionByName(pick(change, "LABEL_REVISION", F.col("change"), "events", F.col("n").cast("double")))
        .unionByName(pick(gaps, "EVIDENCE_GAP", F.concat_ws("/", "currency", "feature", "support"), "reference_rows", F.col("reference_rows").cast("double")))
    )


# -- the same in SQL -------------------------------------------------------------------------------------------------


def _asof(us, name="sel"):
    return f"{name} as (select * exclude (rn) from (select *, row_number() over (partition by event_id order by revision desc) as rn from labels_rev where observed_us <= {us}) where rn = 1)"


def _r(x):
    return f"round(({x}) + 1e-9, 6)"


_SCORED = f"{with_views('labels_rev', 'predictions')}, {_asof(ASOF_2)}, scored as (select predictions.*, cast(outcome = 'FRAUD' as integer) as fraud_label, revision from predictions join sel using (event_id))"
_SPLIT = f"case when ingestion_us < {TRAIN} then 'train' when ingestion_us < {VALIDATION} then 'validation' when ingestion_us < {TEST} then 'test' else 'outside' end"
_COHORT = f"{with_views('labels_rev')}, {_asof(ASOF_2)}, ds as (select tx.*, cast(outcome = 'FRAUD' as integer) as fraud_label, observed_us from tx join sel using (event_id) where ingestion_us <= {ASOF_2}), co as (select *, case when ingestion_us < {TRAIN} and observed_us > {TRAIN} then 'label_delayed' else {_SPLIT} end as cohort from ds)"


def _conf(src, *keys):
    k = ", ".join(keys)
    return f"""cm as (select {k}, count(case when p >= 0.5 and fraud_label = 1 then 1 end) as tp, count(case when p >= 0.5 and fraud_label = 0 then 1 end) as fp, count(case when p < 0.5 and fraud_label = 1 then 1 end) as fn, count(case when p < 0.5 and fraud_label = 0 then 1 end) as tn from {src} group by {k})
 select {k}, tp, fp, fn, tn, {_r('cast(tp as double) / nullif(tp + fp, 0)')} as precision, {_r('cast(tp as double) / nullif(tp + fn, 0)')} as recall, {_r('cast(2 * tp as double) / nullif(2 * tp + fp + fn, 0)')} as f1"""


_SIDE = f"case when ingestion_us >= {REF[0]} and ingestion_us < {REF[1]} then 'reference' when ingestion_us >= {COMP[0]} and ingestion_us < {COMP[1]} then 'comparison' end"
_FV = _FEAT.replace(with_views(), with_views("labels_rev", "predictions"))
_SIDES = f"{_FV}, sides as (select *, {_SIDE} as side from stat where {_SIDE} is not null)"


def _unpivot(columns, keys="side", src="sides", name="long", cast="cast({} as double)"):
    return f"{name} as (" + " union all ".join(f"select {keys}, '{c}' as feature, {cast.format(c)} as x from {src}" for c in columns) + ")"


def _summary(keys):
    return f"""select {keys}, count(*) as rows, count(*) - count(x) as nulls, {_r('cast(count(*) - count(x) as double) / count(*)')} as missing_fraction, {_r('min(x)')} as minimum, {_r('max(x)')} as maximum, {_r('avg(x)')} as mean,
 {_r('quantile_cont(x, 0.05)')} as p05, {_r('quantile_cont(x, 0.5)')} as median, {_r('quantile_cont(x, 0.95)')} as p95 from long group by {keys}"""


def _ks(keys, src="long", name="ks"):
    return f"""{name}_v as (select {keys}, x, count(case when side = 'reference' then 1 end) as a, count(case when side = 'comparison' then 1 end) as b from {src} where x is not null group by {keys}, x),
 {name}_c as (select {keys}, cast(sum(a) over (partition by {keys} order by x) as double) / nullif(sum(a) over (partition by {keys}), 0) as fa, cast(sum(b) over (partition by {keys} order by x) as double) / nullif(sum(b) over (partition by {keys}), 0) as fb from {name}_v),
 {name} as (select {keys}, {_r('max(abs(fa - fb))')} as ks from {name}_c group by {keys})"""


def _psi(src="long"):
    qs = ", ".join(str(i / 10) for i in range(1, 10))
    return f"""edges0 as (select feature, quantile_cont(x, [{qs}]) as e, min(x) as lo, max(x) as hi from {src} where side = 'reference' and x is not null group by feature),
 edges as (select feature, lo, hi, list_sort(list_filter(list_distinct(e), lambda t: t > lo and t < hi)) as e from edges0),
 binned as (select feature, len(list_filter(e, lambda t: t <= x)) as bin, count(case when side = 'reference' then 1 end) as a, count(case when side = 'comparison' then 1 end) as b from {src} join edges using (feature) where x is not null group by 1, 2),
 grid as (select feature, lo, hi, len(e) + 1 as k, unnest(range(0, len(e) + 1)) as bin from edges),
 cells as (select grid.*, coalesce(a, 0) as a, coalesce(b, 0) as b from grid left join binned using (feature, bin)),
 pq as (select feature, lo, hi, k, b, (a + 0.5::double) / (sum(a) over (partition by feature) + 0.5::double * k) as p, (b + 0.5::double) / (sum(b) over (partition by feature) + 0.5::double * k) as q from cells),
 ps as (select feature, cast(max(k) as bigint) as effective_bins, case when sum(b) = 0 then 'EMPTY_NON_NULL_COHORT' when min(lo) = max(hi) then 'DEGENERATE_REFERENCE' when max(k) < 2 then 'INSUFFICIENT_EFFECTIVE_BINS' else 'AVAILABLE' end as psi_status, sum((q - p) * ln(q / p)) as s from pq group by feature)
 select feature, effective_bins, psi_status, case when psi_status = 'AVAILABLE' then {_r('s')} end as psi from ps"""


_SHIFTED = "sides2 as (select * replace (case when side = 'comparison' and currency = 'GBP' then case when event_id % 2 = 0 then 'CHF' end else currency end as currency) from sides)"


def _shift(src="long"):
    return f"""cat as (select feature, coalesce(x, '<MISSING>') as category, count(case when side = 'reference' then 1 end) as a, count(case when side = 'comparison' then 1 end) as b from {src} group by 1, 2),
 cpq as (select *, cast(a as double) / sum(a) over (partition by feature) as p, cast(b as double) / sum(b) over (partition by feature) as q from cat),
 shift as (select feature, {_r('sum(abs(p - q)) / 2')} as total_variation, {_r('sum((case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2)')} as jensen_shannon,
 count(case when a = 0 and b > 0 then 1 end) as new_categories, count(case when a > 0 and b = 0 then 1 end) as disappeared_categories from cpq group by feature)"""


def _gate(keys, src="long"):
    return f"""gate as (select {keys}, count(case when side = 'reference' then 1 end) as reference_rows, count(case when side = 'comparison' then 1 end) as comparison_rows, count(case when side = 'reference' then x end) as reference_non_null, count(case when side = 'comparison' then x end) as comparison_non_null from {src} group by {keys}),
 gated as (select *, case when least(reference_rows, comparison_rows) < 500 then 'INSUFFICIENT_ROWS' when least(reference_non_null, comparison_non_null) < 400 then 'INSUFFICIENT_NON_NULL' else 'AVAILABLE' end as support from gate)"""


_RESOLVED = f"""{with_views('feedback', 'predictions')}, fb as (select provider_id, provider_case_id, event_id, source_revision, status, received_us from feedback union all select 'provider-c', 'c-' || provider_case_id, event_id, source_revision, 'CONFIRMED_FRAUD', received_us from feedback where event_id % 63 = 0),
 av as (select *, max(received_us) over (partition by provider_id, provider_case_id order by source_revision) as available_us from fb),
 cs as (select provider_id, provider_case_id, max(event_id) as event_id, arg_max(status, source_revision) filter (where available_us <= {FB_ASOF}) as status from av group by 1, 2),
 pe as (select event_id, count(*) as cases, bool_or(status = 'CONFIRMED_FRAUD') as f, bool_or(status = 'CONFIRMED_LEGIT') as l, bool_or(status = 'RETRACTED') as r, bool_or(status = 'PENDING') as q from cs group by 1),
 resolved as (select tx.event_id, ingestion_us, case when f and l then 'AMBIGUOUS' when f then 'FRAUD' when l then 'LEGIT' when r then 'RETRACTED' when q then 'PENDING' when cases > 0 then 'NOT_YET_OBSERVED' else 'NO_CASE' end as state, coalesce(cases, 0) as cases from tx left join pe using (event_id))"""
_H = "(observed_us - ingestion_us) / 3600000000.0::double"
_COVERAGE = f"""select count(*) as scored, count(outcome) as labelled, {_r('cast(count(outcome) as double) / count(*)')} as coverage, count(case when revision = 1 then 1 end) as first_revision, count(case when revision > 1 then 1 end) as later_revision,
 {_r(f'min({_H})')} as delay_min, {_r(f'quantile_cont({_H}, 0.5)')} as delay_median, {_r(f'max({_H})')} as delay_max, count(case when {_H} < 24 then 1 end) as under_24h, count(case when {_H} >= 24 and {_H} < 168 then 1 end) as under_7d, count(case when {_H} >= 168 then 1 end) as over_7d"""
_CHANGE = """case when a.outcome is null and b.outcome is null then 'UNLABELLED' when a.outcome is null then 'NEW' when b.outcome is null then 'LOST' when a.outcome <> b.outcome then 'FLIPPED' when a.revision <> b.revision then 'REVISED' else 'UNCHANGED' end"""
_PSIDE = f"pside as (select *, {_SIDE} as side from predictions where {_SIDE} is not null), plong as (select side, 'p' as feature, p as x from pside)"
_AGE = f"({FB_ASOF} - ingestion_us) / 3600000000.0::double"

QUERIES = {
    "labels_asof": (labels_asof, f"{with_views('labels_rev')}, {_asof(ASOF_1)} select event_id, outcome, observed_us, label_source, revision from sel"),
    "labels_contiguity": (labels_contiguity, f"""{with_views('labels_rev')}, b as (select *, cast(revision <> row_number() over (partition by event_id order by revision) as integer) as gap, coalesce(cast(observed_us < lag(observed_us) over (partition by event_id order by revision) as integer), 0) as back from labels_rev where not (revision = 1 and event_id % 99 = 0))
 select event_id, count(*) as revisions, cast(sum(gap) as bigint) as gaps, cast(sum(back) as bigint) as backwards from b group by 1 having sum(gap) > 0 or sum(back) > 0"""),
    "dataset_asof": (dataset_asof, f"{_FV}, {_asof(ASOF_1)} select event_id, amount, prior_transaction_count_5m, statistical_feature_status, cast(outcome = 'FRAUD' as integer) as fraud_label, observed_us, label_source, revision from stat join sel using (event_id) where ingestion_us <= {ASOF_1}"),
    "dataset_counts": (dataset_counts, f"""{with_views('labels_rev')}, {_asof(ASOF_1)}, j as (select ingestion_us, outcome, observed_us from (select event_id, ingestion_us from tx where ingestion_us <= {ASOF_1} and event_id % 50 <> 7) k full join sel using (event_id))
 select count(ingestion_us) as features, count(outcome) as labels, count(case when ingestion_us is not null and outcome is not null then 1 end) as labelled, count(case when outcome is null then 1 end) as unlabelled, count(case when ingestion_us is null then 1 end) as without_features, count(case when observed_us < ingestion_us then 1 end) as before_ingestion from j"""),
    "temporal_cohorts": (temporal_cohorts, f"{_COHORT} select cohort, fraud_label, count(*) as rows, min(ingestion_us) as first_us, max(ingestion_us) as last_us from co group by 1, 2"),
    "class_weights": (class_weights, f"{_COHORT}, g as (select cohort, fraud_label, count(*) as rows from co group by 1, 2) select cohort, fraud_label, rows, {_r('cast(sum(rows) over (partition by cohort) as double) / (2.0 * rows)')} as weight from g"),
    "cohort_quality": (cohort_quality, f"""{with_views('labels_rev')}, {_asof(ASOF_2)}, c as (select tx.*, {_SPLIT} as cohort, case {_SPLIT} when 'train' then 0 when 'validation' then 1 when 'test' then 2 end as idx, outcome, observed_us from tx left join sel using (event_id) where ingestion_us < {TEST}),
 f as (select customer_id, min(idx) as first_idx from c group by 1) select cohort, count(*) as events, count(outcome) as labelled, count(case when outcome = 'FRAUD' then 1 end) as fraud, count(case when outcome = 'LEGIT' then 1 end) as legit,
 count(case when observed_us - ingestion_us <= 86400000000 then 1 end) as short_delay, count(case when observed_us - ingestion_us > 86400000000 then 1 end) as long_delay, count(case when outcome is not null and (cohort <> 'train' or observed_us <= {TRAIN}) then 1 end) as eligible,
 count(distinct customer_id) as customers, count(distinct case when idx = first_idx then customer_id end) as new_customers from c join f using (customer_id) group by 1"""),
    "confusion_at_half": (confusion_at_half, f"{_SCORED}, {_conf('scored', 'currency')} from cm"),
    "average_precision": (average_precision, f"""{_SCORED}, g as (select currency, p, sum(fraud_label) as pos, count(*) as n from scored group by 1, 2), w as (select currency, cast(pos as double) / sum(pos) over (partition by currency) as dr, cast(sum(pos) over (partition by currency order by p desc) as double) / sum(n) over (partition by currency order by p desc) as pr from g)
 select currency, {_r('sum(dr * pr)')} as average_precision from w group by 1"""),
    "roc_auc": (roc_auc, f"""{_SCORED}, r as (select currency, fraud_label, rank() over (partition by currency order by p) + (count(*) over (partition by currency, p) - 1) / 2.0::double as rk from scored),
 s as (select currency, sum(case when fraud_label = 1 then rk end) as r1, cast(sum(fraud_label) as double) as n1, cast(sum(1 - fraud_label) as double) as n0 from r group by 1) select currency, {_r('(r1 - n1 * (n1 + 1) / 2) / (n1 * n0)')} as roc_auc from s"""),
    "outcome_coverage": (outcome_coverage, f"{with_views('labels_rev', 'predictions')}, {_asof(ASOF_1)} {_COVERAGE} from predictions left join sel using (event_id)"),
    "outcome_segments": (outcome_segments, f"""{_SCORED}, u as (select p, fraud_label, 'currency' as dimension, currency as value from scored union all select p, fraud_label, 'country', country from scored union all select p, fraud_label, 'transaction_type', transaction_type from scored), {_conf('u', 'dimension', 'value')},
 case when tp + fp + fn + tn < 20 then 'INSUFFICIENT_ROWS' when least(tp + fn, fp + tn) < 2 then 'INSUFFICIENT_CLASS_SUPPORT' else 'AVAILABLE' end as support from cm"""),
    "outcome_support_gate": (outcome_support_gate, f"{_SCORED} select customer_id, count(*) as rows, cast(sum(fraud_label) as bigint) as positives, case when count(*) < 60 then 'INSUFFICIENT_ROWS' when least(sum(fraud_label), count(*) - sum(fraud_label)) < 5 then 'INSUFFICIENT_CLASS_SUPPORT' else 'AVAILABLE' end as support from scored group by 1"),
    "outcome_compare": (outcome_compare, f"{with_views('labels_rev', 'predictions')}, {_asof(ASOF_1, 'a')}, {_asof(ASOF_2, 'b')} select {_CHANGE} as change, count(*) as events from predictions left join a using (event_id) left join b using (event_id) group by 1"),
    "feedback_availability": (feedback_availability, f"{with_views('feedback')} select provider_id, provider_record_id, source_revision, max(received_us) over (partition by provider_id, provider_case_id order by source_revision) as available_us from feedback"),
    "feedback_resolved": (feedback_resolved, f"{_RESOLVED} select event_id, state, cases from resolved"),
    "feedback_buckets": (feedback_buckets, f"{_RESOLVED} select state, count(*) as events, {_r(f'min({_AGE})')} as age_min, {_r(f'quantile_cont({_AGE}, 0.5)')} as age_median, {_r(f'max({_AGE})')} as age_max from resolved group by 1"),
    "feedback_quality": (feedback_quality, f"{_RESOLVED}, q as (select predictions.*, cast(state = 'FRAUD' as integer) as fraud_label from predictions join resolved using (event_id) where state in ('FRAUD', 'LEGIT')), {_conf('q', 'country')} from cm"),
    "feedback_ingest_checks": (feedback_ingest_checks, f"""{with_views('feedback')}, b1 as (select * replace (case when source_revision = 3 then event_id + 1000000000 else event_id end as event_id) from feedback where not (source_revision = 1 and event_id % 45 = 0)),
 b2 as (select * replace (case when event_id % 51 = 0 then {EPOCH_US - 1} else received_us end as received_us) from b1), c as (select b2.*, tx.ingestion_us as known_us, row_number() over w as rn, lag(b2.event_id) over w as le from b2 left join tx on tx.event_id = b2.event_id window w as (partition by provider_id, provider_case_id order by source_revision))
 select count(*) as records, count(case when known_us is null then 1 end) as unknown_events, count(case when received_us < known_us then 1 end) as before_ingestion, count(case when rn <> source_revision then 1 end) as revision_gaps, count(case when le <> event_id then 1 end) as moved_cases from c"""),
    "feedback_merge": (feedback_merge, f"""{with_views('feedback')}, m as (select provider_record_id, status, 1 as old from feedback where source_revision = 1 union all select provider_record_id, case when event_id % 36 = 0 then 'RETRACTED' else status end, 0 from feedback where source_revision = 2 or event_id % 12 = 0),
 g as (select provider_record_id, count(*) as n, count(distinct status) as k, max(old) as o from m group by 1) select case when k > 1 then 'CONFLICT' when n > 1 then 'DUPLICATE' when o = 1 then 'KNOWN' else 'NEW' end as resolution, count(*) as records, cast(sum(n) as bigint) as deliveries from g group by 1"""),
    "numeric_summary": (numeric_summary, f"{_SIDES}, {_unpivot(FEATURES)} {_summary('side, feature')}"),
    "ks_distance": (ks_distance, f"{_SIDES}, {_unpivot(FEATURES)}, {_ks('feature')} select feature, ks, case when ks is null then 'EMPTY_NON_NULL_COHORT' else 'AVAILABLE' end as ks_status from ks"),
    "psi": (psi, f"{_SIDES}, {_unpivot(FEATURES)}, {_psi()}"),
    "psi_degenerate": (psi_degenerate, f"{_SIDES}, long as (select side, 'amount' as feature, case when side = 'reference' then 7.0::double else cast(amount as double) end as x from sides), {_psi()}"),
    "categorical_tvd_js": (categorical_tvd_js, f"{_SIDES}, {_SHIFTED}, {_unpivot(CATEGORIES, src='sides2', cast='{}')}, {_shift()} select * from shift"),
    "category_changes": (category_changes, f"{_SIDES}, {_SHIFTED}, {_unpivot(CATEGORIES, src='sides2', cast='{}')}, {_shift()} select feature, category, a as reference_count, b as comparison_count, case when a = 0 then 'NEW' when b = 0 then 'DISAPPEARED' else 'SHARED' end as change from cat"),
    "score_share": (score_share, f"{with_views('predictions')}, {_PSIDE} select side, count(*) as rows, {_r('avg(cast(p >= 0.5 as double))')} as share from pside group by 1"),
    "currency_strata": (currency_strata, f"{_SIDES}, {_unpivot(MONEY, 'side, currency')}, {_ks('currency, feature')} select currency, feature, ks, case when ks is null then 'EMPTY_NON_NULL_COHORT' else 'AVAILABLE' end as ks_status from ks"),
    "currency_strata_summary": (currency_strata_summary, f"{_SIDES}, {_unpivot(MONEY, 'side, currency')} {_summary('currency, side, feature')}"),
    "drift_support_gate": (drift_support_gate, f"{_SIDES}, {_unpivot(MONEY, 'side, currency')}, {_gate('currency, feature')} select * from gated"),
    "drift_compare": (drift_compare, f"""{with_views('predictions')}, {_PSIDE}, {_ks('feature', 'plong', 'k1')}, qside as (select case when ingestion_us < {day(8)} then 'reference' else 'comparison' end as side, 'p' as feature, p as x from predictions where ingestion_us >= {day(2)} and ingestion_us < {day(14)}), {_ks('feature', 'qside', 'k2')}
 select feature, k1.ks as first_ks, k2.ks as second_ks, {_r('k2.ks - k1.ks')} as change from k1 join k2 using (feature)"""),
    "investigation_findings": (investigation_findings, f"""{_SIDES}, {_unpivot(FEATURES)}, {_unpivot(MONEY, 'side, currency', name='mlong')}, {_unpivot(CATEGORIES, name='clong', cast='{}')}, {_PSIDE}, {_ks('feature')}, {_ks('currency, feature', 'mlong', 'mk')}, {_ks('feature', 'plong', 'pk')}, {_shift('clong')}, {_gate('currency, feature', 'mlong')}, {_asof(ASOF_1, 'a')}, {_asof(ASOF_2, 'b')}
 select 'MISSINGNESS' as kind, feature as subject, 'missing_fraction' as measure, {_r('cast(count(*) - count(x) as double) / count(*)')} as value from long where side = 'comparison' group by feature having count(x) < count(*)
 union all select 'FEATURE_DISTRIBUTION', feature, 'ks', {_r('ks')} from ks where ks is not null union all select 'POPULATION_COMPOSITION', feature, 'total_variation', {_r('total_variation')} from shift
 union all select 'PREDICTION_DISTRIBUTION', feature, 'ks', {_r('ks')} from pk union all select 'CURRENCY_STRATIFICATION', currency || '/' || feature, 'ks', {_r('ks')} from mk where ks is not null
 union all select 'LABEL_COVERAGE', 'scored', 'coverage', {_r(_r('cast(count(outcome) as double) / count(*)'))} from predictions left join a using (event_id)
 union all select 'LABEL_REVISION', change, 'events', {_r('cast(count(*) as double)')} from (select {_CHANGE} as change from predictions left join a using (event_id) left join b using (event_id)) where change in ('FLIPPED', 'REVISED') group by change
 union all select 'EVIDENCE_GAP', currency || '/' || feature || '/' || support, 'reference_rows', {_r('cast(reference_rows as double)')} from gated where support <> 'AVAILABLE'"""),
}
