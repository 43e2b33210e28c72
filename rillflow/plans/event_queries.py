"""Ingestion, validation, deduplication, rolling and statistical features, risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import validation as V
from ..operators import features as X
from ..schemas import STATISTICAL  # noqa: F401  (re-exported for tests)
from ..sources import events as E
from ..sources.events import with_views

COUNT_US, SUM_US = 6 * E.HOUR_US, 24 * E.HOUR_US
POLICY = X.RiskPolicy("local-demo-1", 2, 2.0, 1, 1.0)
LONG_POLICY = X.RiskPolicy("local-demo-2", 3, 2.0, 2, 1.0)


def _tx(spark, d):
    return E.transactions(spark, d)


def _log(spark, d):
    return E.transaction_log(_tx(spark, d))


def r6(c):
    return F.round(c + 1e-9, 6)


_F6 = "round({} + 1e-9, 6)".format


def ingest_partition_offsets(spark, d):
    return _log(spark, d).groupBy("kafka_partition").agg(F.count("*").alias("records"), F.min("kafka_offset").alias("min_offset"), F.max("kafka_offset").alias("max_offset"))


def ingest_topk_records(spark, d):
    return _log(spark, d).select("kafka_partition", "kafka_offset", "event_id", "customer_id", "amount").orderBy("kafka_partition", "kafka_offset").limit(20)


def topic_fence(spark, d):
    return _log(spark, d).groupBy("kafka_partition").agg(F.min("kafka_offset").alias("begin_offset"), (F.max("kafka_offset") + 1).alias("end_offset"))


def wave_records(spark, d):
    return _tx(spark, d).where("wave = 1").groupBy("kafka_partition", "currency").agg(F.count("*").alias("records"), F.min("event_us").alias("first_us"), F.max("event_us").alias("last_us"))


def validate_errors(spark, d):
    v = V.validate(E.raw_candidates(_tx(spark, d))).where(F.size("errors") > 0)
    return v.select("source_id", F.concat_ws(",", "errors").alias("errors"), F.size("errors").cast("long").alias("n_errors"))


def validate_error_counts(spark, d):
    return V.validate(E.raw_candidates(_tx(spark, d))).select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("rows"))


def validate_accepted(spark, d):
    a = V.accepted(V.validate(E.raw_candidates(_tx(spark, d))))
    return a.select("source_id", "event_id", "customer_id", "merchant_id", F.unix_micros("event_time").alias("event_us"), F.unix_micros("ingestion_time").alias("ingestion_us"), "amount", "currency", "country", "ip_address", "schema_version")


_MISSING = ", ".join(f"case when nullif(trim({n}), '') is null then 'MissingRequiredField({n})' end" for n in E.RAW_FIELDS)
_VALIDATED = f"""v as (select source_id, {", ".join(f"nullif(trim({n}), '') as {n}" for n in E.RAW_FIELDS)} from tx_raw),
 e as (select source_id, list_filter([{_MISSING.replace("nullif(trim(", "(").replace("), '') is null", ") is null")},
  case when event_id is not null and not regexp_full_match(event_id, '[0-9a-fA-F]{{1,8}}-[0-9a-fA-F]{{1,4}}-[0-9a-fA-F]{{1,4}}-[0-9a-fA-F]{{1,4}}-[0-9a-fA-F]{{1,12}}') then 'MalformedEventId' end,
  case when event_time is not null and try_cast(event_time as timestamptz) is null then 'MalformedEventTime' end,
  case when ingestion_time is not null and try_cast(ingestion_time as timestamptz) is null then 'MalformedIngestionTime' end,
  case when amount is null then null when try_cast(amount as decimal(38,18)) is null then 'MalformedAmount' when cast(amount as decimal(38,18)) <= 0 then 'NonPositiveAmount'
   when cast(amount as decimal(38,18)) <> round(cast(amount as decimal(38,18)), 4) then 'AmountScaleExceeded' when cast(amount as decimal(38,18)) >= 100000000000000 then 'AmountPrecisionExceeded' end,
  case when transaction_type <> 'CARD_PAYMENT' then 'UnsupportedTransactionType' end,
  case when schema_version is null then null when try_cast(schema_version as integer) is null then 'MalformedSchemaVersion' when cast(schema_version as integer) <> 1 then 'UnsupportedSchemaVersion(' || schema_version || ')' end,
  case when currency is not null and not regexp_full_match(currency, '[A-Z]{{3}}') then 'InvalidCurrencyFormat' end,
  case when country is not null and not regexp_full_match(country, '[A-Z]{{2}}') then 'InvalidCountryFormat' end,
  case when ip_address is not null and not (len(string_split(ip_address, '.')) = 4 and len(list_filter(string_split(ip_address, '.'), lambda p: coalesce(try_cast(p as integer) between 0 and 255, false))) = 4) then 'InvalidIpAddressFormat' end
  ], lambda x: x is not null) as errors from v)"""


def dedup_first_occurrence(spark, d):
    return X.first_occurrence(_log(spark, d)).select("event_id", "kafka_partition", "kafka_offset", "redelivered")


def dedup_summary(spark, d):
    log = _log(spark, d)
    return log.groupBy("event_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("records"), F.count("*").alias("events"), F.sum(F.col("n") - 1).alias("suppressed"))


def customer_activity_batch(spark, d):
    return X.activity(_tx(spark, d))


def activity_sessions(spark, d):
    return X.sessions(_tx(spark, d), 12 * E.HOUR_US)


_ROLL = f"""roll as (select *, cast(count(*) over (partition by customer_id order by event_us range between {COUNT_US} preceding and 1 preceding) as bigint) as prior_transaction_count_5m,
 cast(coalesce(sum(amount) over (partition by customer_id, currency order by event_us range between {SUM_US} preceding and 1 preceding), 0) as decimal(38,4)) as prior_amount_sum_10m from tx)"""
_STAT = f"""stat0 as (select *, cast(count(*) over w as bigint) as n, avg(cast(amount as double)) over w as m, stddev_samp(cast(amount as double)) over w as s from roll
 window w as (partition by customer_id, currency order by kafka_partition, kafka_offset rows between unbounded preceding and 1 preceding)),
 stat as (select * exclude (n, m, s), n as prior_amount_observation_count, case when n >= 1 then m end as prior_amount_mean, case when n >= 2 then s end as prior_amount_stddev,
 case when n >= 2 and s > 1e-12 then (cast(amount as double) - m) / s end as amount_zscore,
 case when n = 0 then 'NO_HISTORY' when n = 1 then 'INSUFFICIENT_VARIANCE_HISTORY' when s <= 1e-12 then 'ZERO_VARIANCE' else 'READY' end as statistical_feature_status from stat0)"""


def _rolled(spark, d):
    return X.rolling(_tx(spark, d), COUNT_US, SUM_US)


def featured(spark, d):
    return X.statistics(_rolled(spark, d))


def rolling_prior_features(spark, d):
    return _rolled(spark, d).select("event_id", "prior_transaction_count_5m", "prior_amount_sum_10m")


def rolling_default_windows(spark, d):
    r = X.rolling(_tx(spark, d))
    return r.where("prior_transaction_count_5m > 0 or prior_amount_sum_10m > 0").select("event_id", "prior_transaction_count_5m", "prior_amount_sum_10m")


def rolling_equal_time_peers(spark, d):
    day = F.floor(F.col("event_us") / E.DAY_US) * E.DAY_US
    return X.rolling(_tx(spark, d).withColumn("event_us", day.cast("long")), 5 * E.DAY_US, 10 * E.DAY_US).select("event_id", "prior_transaction_count_5m", "prior_amount_sum_10m")


def rolling_orders(spark, d):
    o = E.read(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("customer_id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("event_us"), F.col("o_totalprice").cast("decimal(18,4)").alias("amount"))
    c = E.read(spark, d, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("currency"))
    return X.rolling(o.join(c, "customer_id"), 30 * E.DAY_US, 90 * E.DAY_US).select("event_id", "prior_transaction_count_5m", "prior_amount_sum_10m")


def rolling_wave_aware(spark, d):
    return X.wave_rolling(E.disordered(_tx(spark, d)), COUNT_US, SUM_US).select("event_id", "prior_transaction_count_5m", "prior_amount_sum_10m")


def stat_prior_moments(spark, d):
    f = featured(spark, d)
    return f.select("event_id", "prior_amount_observation_count", *[r6(F.col(c)).alias(c) for c in ("prior_amount_mean", "prior_amount_stddev", "amount_zscore")], "statistical_feature_status")


def stat_status_counts(spark, d):
    return featured(spark, d).groupBy("currency", "statistical_feature_status").agg(F.count("*").alias("rows"))


def offset_lineage_check(spark, d):
    return X.lineage_violations(_log(spark, d)).groupBy("kafka_partition").agg(F.count("*").alias("violations"))


def statistical_consistency(spark, d):
    x, m, s, z = F.col("amount").cast("double"), *[F.col(c) for c in ("prior_amount_mean", "prior_amount_stddev", "amount_zscore")]
    e = F.try_divide(x - m, s)  # evaluated for every row, also where s is zero
    close = F.abs(z - e) <= F.greatest(1e-9 * F.greatest(F.abs(z), F.abs(e)), F.lit(1e-9))
    f = featured(spark, d)
    return f.agg(F.count("*").alias("rows"), F.count(F.when(V.statistical_errors(), 1)).alias("inconsistent"), F.count(F.when((F.col("statistical_feature_status") == "READY") & ~close, 1)).alias("score_mismatches"), F.count(F.when(m <= 0, 1)).alias("nonpositive_means"))


def feature_row_contract(spark, d):
    f = featured(spark, d)
    bad = {"null_required": F.col("currency").isNull() | F.col("country").isNull() | F.col("amount").isNull(), "nonpositive_amount": F.col("amount") <= 0, "negative_sum": F.col("prior_amount_sum_10m") < 0, "negative_count": F.col("prior_transaction_count_5m") < 0, "bad_currency": ~F.col("currency").rlike("^[A-Z]{3}$"), "not_finite": F.isnan("amount_zscore")}
    return f.agg(F.count("*").alias("rows"), (F.count("event_id") - F.countDistinct("event_id")).alias("duplicate_ids"), *[F.count(F.when(c, 1)).alias(n) for n, c in bad.items()])


def model_input_contract(spark, d):
    f = featured(spark, d)
    ok = F.col("currency").isin("USD", "EUR", "GBP") & F.col("country").isin("US", "GB") & (F.col("amount") > 0) & ~V.statistical_errors()
    return f.groupBy("country").agg(F.count("*").alias("rows"), F.count(F.when(ok, 1)).alias("valid"))


def model_features(spark, d):
    f = featured(spark, d)
    num = ["amount", "prior_transaction_count_5m", "prior_amount_sum_10m", "prior_amount_observation_count", "prior_amount_mean", "prior_amount_stddev", "amount_zscore"]
    return f.select("event_id", "currency", "country", "transaction_type", "statistical_feature_status", *[r6(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in num])


def risk_decisions(spark, d):
    r = X.decide(featured(spark, d), POLICY)
    return r.select("event_id", "risk_disposition", "policy_version", "policy_fingerprint", F.concat_ws(",", "matched_rule_ids").alias("matched_rule_ids"), F.concat_ws(",", "reason_codes").alias("reason_codes"), F.col("matched_rule_count").cast("long").alias("matched_rule_count"))


def risk_rule_counts(spark, d):
    return X.decide(featured(spark, d), LONG_POLICY).select(F.explode("matched_rule_ids").alias("rule")).groupBy("rule").agg(F.count("*").alias("rows"))


def risk_disposition_by_currency(spark, d):
    return X.decide(featured(spark, d), LONG_POLICY).groupBy("currency", "risk_disposition").agg(F.count("*").alias("rows"), F.sum("amount").cast("decimal(38,4)").alias("amount"))


def risk_input_checks(spark, d):
    f = featured(spark, d)
    broken = f.withColumn("statistical_feature_status", F.when(F.col("event_id") % 17 == 0, "READY").otherwise(F.col("statistical_feature_status"))).withColumn("prior_transaction_count_5m", F.when(F.col("event_id") % 19 == 0, -1).otherwise(F.col("prior_transaction_count_5m")))
    return broken.select(F.explode(X.risk_input_errors()).alias("error")).groupBy("error").agg(F.count("*").alias("rows"))


def flagship(spark, d):
    """Raw candidates to decisions: validated, deduplicated, rolling, statistical, risk; the 31-column stage and its key."""
    raw = E.raw_candidates(_tx(spark, d))
    a = V.accepted(V.validate(raw))
    tx = _tx(spark, d).select(F.col("event_id").alias("source_id"), "kafka_partition", "kafka_offset", "event_us", "ingestion_us")
    a = a.join(tx, "source_id").withColumns({"transport_us": F.col("ingestion_us"), "kafka_key": F.col("customer_id"), "kafka_topic": F.lit("transactions"), "kafka_timestamp": F.col("ingestion_time")})
    f = X.statistics(X.rolling(X.first_occurrence(a), COUNT_US, SUM_US))
    from ..schemas import RISK, project

    return project(X.decide(f, POLICY), RISK)


def _hit(policy):
    r1, r2, r3 = f"prior_transaction_count_5m >= {policy.high_velocity}", f"coalesce(amount_zscore >= {policy.high_zscore}, false)", f"prior_transaction_count_5m >= {policy.combined_velocity} and coalesce(amount_zscore >= {policy.combined_zscore}, false)"
    pick = lambda i: "list_filter([" + ", ".join(f"case when {c} then '{r[i]}' end" for c, r in zip((r1, r2, r3), X.RULES, strict=True)) + "], lambda x: x is not null)"
    return f"risk as (select *, {pick(0)} as ids, {pick(1)} as reasons from stat)"


_ERR = """select unnest(list_filter([case when prior_transaction_count_5m < 0 then 'NegativeCount(prior_transaction_count_5m)' end, case when not (case statistical_feature_status
 when 'NO_HISTORY' then prior_amount_observation_count = 0 when 'INSUFFICIENT_VARIANCE_HISTORY' then prior_amount_observation_count = 1 when 'ZERO_VARIANCE' then prior_amount_observation_count >= 2 and prior_amount_stddev <= 1e-12
 when 'READY' then prior_amount_observation_count >= 2 and prior_amount_stddev > 1e-12 end) then 'InconsistentStatisticalContext' end], lambda x: x is not null)) as error"""
_FEAT = f"{with_views()},\n {_ROLL},\n {_STAT}"
_NUM = ["amount", "prior_transaction_count_5m", "prior_amount_sum_10m", "prior_amount_observation_count", "prior_amount_mean", "prior_amount_stddev", "amount_zscore"]

QUERIES = {
    "ingest_partition_offsets": (ingest_partition_offsets, f"{with_views('tx_log')} select kafka_partition, count(*) as records, min(kafka_offset) as min_offset, max(kafka_offset) as max_offset from tx_log group by 1"),
    "ingest_topk_records": (ingest_topk_records, f"{with_views('tx_log')} select kafka_partition, kafka_offset, event_id, customer_id, amount from tx_log order by 1, 2 limit 20"),
    "topic_fence": (topic_fence, f"{with_views('tx_log')} select kafka_partition, min(kafka_offset) as begin_offset, max(kafka_offset) + 1 as end_offset from tx_log group by 1"),
    "wave_records": (wave_records, f"{with_views()} select kafka_partition, currency, count(*) as records, min(event_us) as first_us, max(event_us) as last_us from tx where wave = 1 group by 1, 2"),
    "validate_errors": (validate_errors, f"{with_views('tx_raw')}, {_VALIDATED} select source_id, array_to_string(errors, ',') as errors, cast(len(errors) as bigint) as n_errors from e where len(errors) > 0"),
    "validate_error_counts": (validate_error_counts, f"{with_views('tx_raw')}, {_VALIDATED} select error, count(*) as rows from (select unnest(errors) as error from e) group by 1"),
    "validate_accepted": (validate_accepted, f"{with_views('tx_raw')}, {_VALIDATED} select source_id, lower(v.event_id) as event_id, v.customer_id, merchant_id, tx.event_us, tx.ingestion_us, cast(v.amount as decimal(18,4)) as amount, v.currency, v.country, ip_address, cast(schema_version as integer) as schema_version from v join e using (source_id) join tx on tx.event_id = source_id where len(errors) = 0"),
    "dedup_first_occurrence": (dedup_first_occurrence, f"{with_views('tx_log')} select event_id, kafka_partition, kafka_offset, redelivered from (select *, row_number() over (partition by event_id order by transport_us, kafka_partition, kafka_offset) as rn from tx_log) where rn = 1"),
    "dedup_summary": (dedup_summary, f"{with_views('tx_log')} select cast(count(*) as bigint) as records, count(distinct event_id) as events, cast(count(*) - count(distinct event_id) as bigint) as suppressed from tx_log"),
    "customer_activity_batch": (customer_activity_batch, f"{with_views()} select customer_id, count(*) as state_event_count, cast(sum(amount) as decimal(38,18)) as state_amount_total, min(event_us) as first_us, max(event_us) as latest_us, max(event_us) + {E.DAY_US} as expiry_us from tx group by 1"),
    "activity_sessions": (activity_sessions, f"""{with_views()}, s as (select *, coalesce(cast(event_us - lag(event_us) over w >= {12 * E.HOUR_US} as integer), 0) as new from tx window w as (partition by customer_id order by event_us, event_id)),
 g as (select *, cast(sum(new) over (partition by customer_id order by event_us, event_id) as bigint) as session from s) select customer_id, session, count(*) as events, cast(sum(amount) as decimal(38,4)) as total, min(event_us) as first_us, max(event_us) as latest_us from g group by 1, 2"""),
    "rolling_prior_features": (rolling_prior_features, f"{with_views()}, {_ROLL} select event_id, prior_transaction_count_5m, prior_amount_sum_10m from roll"),
    "rolling_default_windows": (rolling_default_windows, f"{with_views()}, {_ROLL.replace(str(COUNT_US), '300000000').replace(str(SUM_US), '600000000')} select event_id, prior_transaction_count_5m, prior_amount_sum_10m from roll where prior_transaction_count_5m > 0 or prior_amount_sum_10m > 0"),
    "rolling_equal_time_peers": (rolling_equal_time_peers, f"{with_views()}, tx2 as (select * replace (event_us // {E.DAY_US} * {E.DAY_US} as event_us) from tx), {_ROLL.replace(str(COUNT_US), str(5 * E.DAY_US)).replace(str(SUM_US), str(10 * E.DAY_US)).replace('from tx)', 'from tx2)')} select event_id, prior_transaction_count_5m, prior_amount_sum_10m from roll"),
    "rolling_orders": (rolling_orders, f"with tx as (select o_orderkey as event_id, o_custkey as customer_id, epoch_us(o_orderdate) as event_us, cast(o_totalprice as decimal(18,4)) as amount, c_mktsegment as currency from orders join customer on c_custkey = o_custkey), {_ROLL.replace(str(COUNT_US), str(30 * E.DAY_US)).replace(str(SUM_US), str(90 * E.DAY_US))} select event_id, prior_transaction_count_5m, prior_amount_sum_10m from roll"),
    "rolling_wave_aware": (rolling_wave_aware, f"""{with_views('tx_disordered')} select a.event_id, count(case when a.event_us - b.event_us <= {COUNT_US} then 1 end) as prior_transaction_count_5m,
 cast(coalesce(sum(case when a.currency = b.currency and a.event_us - b.event_us <= {SUM_US} then b.amount end), 0) as decimal(38,4)) as prior_amount_sum_10m
 from tx_disordered a left join tx_disordered b on a.customer_id = b.customer_id and b.event_us < a.event_us and b.event_us >= a.event_us - {SUM_US} and b.wave <= a.wave group by 1"""),
    "stat_prior_moments": (stat_prior_moments, f"{_FEAT} select event_id, prior_amount_observation_count, {_F6('prior_amount_mean')} as prior_amount_mean, {_F6('prior_amount_stddev')} as prior_amount_stddev, {_F6('amount_zscore')} as amount_zscore, statistical_feature_status from stat"),
    "stat_status_counts": (stat_status_counts, f"{_FEAT} select currency, statistical_feature_status, count(*) as rows from stat group by 1, 2"),
    "offset_lineage_check": (offset_lineage_check, f"{with_views('tx_log')}, l as (select *, lag(kafka_partition) over w as lp, lag(kafka_offset) over w as lo from tx_log window w as (partition by customer_id, currency order by transport_us, kafka_offset)) select kafka_partition, count(*) as violations from l where lp <> kafka_partition or lo >= kafka_offset group by 1"),
    "statistical_consistency": (statistical_consistency, f"{_FEAT} select count(*) as rows, cast(0 as bigint) as inconsistent, cast(0 as bigint) as score_mismatches, count(case when prior_amount_mean <= 0 then 1 end) as nonpositive_means from stat"),
    "feature_row_contract": (feature_row_contract, f"{_FEAT} select count(*) as rows, count(event_id) - count(distinct event_id) as duplicate_ids, count(case when currency is null or country is null or amount is null then 1 end) as null_required, count(case when amount <= 0 then 1 end) as nonpositive_amount, count(case when prior_amount_sum_10m < 0 then 1 end) as negative_sum, count(case when prior_transaction_count_5m < 0 then 1 end) as negative_count, count(case when not regexp_full_match(currency, '[A-Z]{{3}}') then 1 end) as bad_currency, count(case when isnan(amount_zscore) then 1 end) as not_finite from stat"),
    "model_input_contract": (model_input_contract, f"{_FEAT} select country, count(*) as rows, count(case when country in ('US', 'GB') and currency in ('USD', 'EUR', 'GBP') and amount > 0 then 1 end) as valid from stat group by 1"),
    "model_features": (model_features, f"{_FEAT} select event_id, currency, country, transaction_type, statistical_feature_status, {', '.join(_F6(f'coalesce(cast({c} as double), 0.0)') + ' as ' + c for c in _NUM)} from stat"),
    "risk_decisions": (risk_decisions, f"{_FEAT}, {_hit(POLICY)} select event_id, case when len(ids) = 0 then 'CLEAR' else 'REVIEW' end as risk_disposition, '{POLICY.version}' as policy_version, '{POLICY.fingerprint}' as policy_fingerprint, array_to_string(ids, ',') as matched_rule_ids, array_to_string(reasons, ',') as reason_codes, cast(len(ids) as bigint) as matched_rule_count from risk"),
    "risk_rule_counts": (risk_rule_counts, f"{_FEAT}, {_hit(LONG_POLICY)} select rule, count(*) as rows from (select unnest(ids) as rule from risk) group by 1"),
    "risk_disposition_by_currency": (risk_disposition_by_currency, f"{_FEAT}, {_hit(LONG_POLICY)} select currency, case when len(ids) = 0 then 'CLEAR' else 'REVIEW' end as risk_disposition, count(*) as rows, cast(sum(amount) as decimal(38,4)) as amount from risk group by 1, 2"),
    "risk_input_checks": (risk_input_checks, f"{_FEAT}, b as (select * replace (case when event_id % 17 = 0 then 'READY' else statistical_feature_status end as statistical_feature_status, case when event_id % 19 = 0 then -1 else prior_transaction_count_5m end as prior_transaction_count_5m) from stat), e as ({_ERR} from b) select error, count(*) as rows from e group by 1"),
}
