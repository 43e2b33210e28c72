"""Streaming runs, models and codecs as queries: each runs to the end and returns what it wrote.

Where order is fixed a stream gives what the batch plan gives, so it has the batch plan's SQL.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import modelling as ML
from ..operators import monitoring as M
from ..session import ROCKSDB
from ..sources import avro_wire as A
from ..sources import events as E
from ..sources.events import with_views
from ..sources.store import VersionedTable, sink
from ..streaming import jobs as J
from .event_queries import _F6, _FEAT, COUNT_US, LONG_POLICY, SUM_US, featured
from .monitoring_queries import _COHORT, ASOF_2, TEST, TRAIN, VALIDATION


def _root(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="rillflow-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex[:12]}"


def _run(spark, d, plan, ddl: str, name: str, columns: str, mode: str = "append", source=None):
    """The transactions as a stream: each wave arrives in as many files as it has tasks, and the query is started again from
    its checkpoint to take it as one batch. The state machines order a key's rows themselves."""
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        root = _root(spark)
        table = VersionedTable(spark, f"{root}/out", ddl)
        config = J.StreamConfig(name, watermark="20 days", timeout="60 days")
        J.claim(spark, f"{root}/checkpoint", config, name)
        tx = (source or E.transactions)(spark, d)
        for w in (0, 1, 2):
            tx.where(F.col("wave") == w).write.mode("append").parquet(f"{root}/in")
            stream = spark.readStream.schema(tx.schema).parquet(f"{root}/in").selectExpr(*[c.strip() for c in columns.split(",")])
            J.run_available(plan(stream, config), f"{root}/checkpoint", f"{name}-{uuid.uuid4().hex[:6]}", sink(table, name), mode)
        return table.read()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def dedup_stream(spark, d):
    """Redeliveries within the watermark are dropped, whichever wave brings them."""
    log = lambda s, p: E.transaction_log(E.transactions(s, p))
    cols = "event_id, event_time, customer_id, amount"
    out = _run(spark, d, J.deduplicated, "event_id long, event_time timestamp, customer_id long, amount decimal(18,4)", "dedup", cols, source=log)
    return out.select("event_id", "customer_id", "amount")


def rolling_stream(spark, d):
    plan = lambda s, c: J.rolling(s, c, COUNT_US, SUM_US)
    out = _run(spark, d, plan, J.ROLLING, "rolling", "event_id, customer_id, event_time, event_us, amount, currency")
    return out.select(F.col("event_id").cast("long").alias("event_id"), "prior_transaction_count_5m", "prior_amount_sum_10m")


def stat_stream(spark, d):
    out = _run(spark, d, J.statistics, J.MOMENTS, "moments", "event_id, customer_id, currency, event_time, event_us, amount, kafka_partition, kafka_offset")
    r6 = lambda c: F.round(F.col(c) + 1e-9, 6).alias(c)
    return out.select(F.col("event_id").cast("long").alias("event_id"), "prior_amount_observation_count", r6("prior_amount_mean"), r6("prior_amount_stddev"), r6("amount_zscore"), "statistical_feature_status")


def activity_stream(spark, d):
    """The last UPDATED row of each customer."""
    out = _run(spark, d, J.activity, J.ACTIVITY, "activity", "customer_id, event_time, event_us, amount", "update")
    last = out.groupBy("customer_id").agg(F.max_by(F.struct("state_event_count", "state_amount_total", "state_first_us", "state_latest_us"), "_version").alias("r"))
    return last.select("customer_id", "r.*")


def risk_stream(spark, d):
    """Decisions over a stream of finished features: stateless, the batch plan itself."""
    root = _root(spark)
    f = featured(spark, d).select("event_id", "currency", "prior_transaction_count_5m", "prior_amount_observation_count", "prior_amount_mean", "prior_amount_stddev", "amount_zscore", "statistical_feature_status")
    f.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(f.schema).parquet(f"{root}/in")
    table = VersionedTable(spark, f"{root}/out", "event_id long, currency string, risk_disposition string, matched_rule_count int")
    plan = X.decide(stream, LONG_POLICY).select("event_id", "currency", "risk_disposition", "matched_rule_count")
    J.run_available(plan, f"{root}/checkpoint", f"risk-{uuid.uuid4().hex[:6]}", sink(table, "risk"))
    return table.read().groupBy("currency", "risk_disposition").agg(F.count("*").alias("rows"))


def store_retry(spark, d):
    """Three waves appended, one of them again and one empty commit: rows and versions stay exact."""
    tx = E.transactions(spark, d).select("event_id", "customer_id", "amount", "wave")
    table = VersionedTable(spark, _root(spark), "event_id long, customer_id long, amount decimal(18,4), wave int")
    for w in (0, 1, 1, 2):
        table.append(tx.where(F.col("wave") == w), "loader", w)
    table.commit_empty("loader", 99)
    return table.read().groupBy(F.col("_version").alias("version")).agg(F.count("*").alias("rows"), F.min("event_id").alias("first_id"))


def avro_roundtrip(spark, d):
    """Accepted candidates encoded, framed and decoded again."""
    from ..functions import validation as V

    good = V.validate(E.raw_candidates(E.transactions(spark, d))).where(F.size("errors") == 0)
    trimmed = good.select(*[F.trim(F.col(n)).alias(n) for n in E.RAW_FIELDS])
    wire = A.encode_records(trimmed)
    source = wire.select("key", "value", F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.lit(0).cast("long").alias("offset"), F.lit(None).cast("timestamp").alias("timestamp"))
    back = A.decode_records(source)
    return back.select("event_id", "customer_id", F.unix_micros(F.try_to_timestamp("event_time")).alias("event_us"), F.col("amount").cast("decimal(18,4)").alias("amount"), "currency", "ip_address", F.coalesce("wire_error", F.lit("")).alias("wire_error"))


def _dataset(spark, d):
    """The three cohorts as a table: fitting reads them several times."""
    ds = M.temporal_cohorts(M.dataset_asof(featured(spark, d), E.label_history(E.transactions(spark, d)), ASOF_2), TRAIN, VALIDATION, TEST)
    path = f"{_root(spark)}/dataset"
    ds.write.parquet(path)
    return spark.read.schema(ds.schema).parquet(path)


def baseline_scores(spark, d):
    ds = _dataset(spark, d)
    model = ML.fit(ds.where("cohort = 'train'"))
    return ML.scored(model, ds.where("cohort in ('validation', 'test')"), ["event_id", "cohort", "fraud_label"]).select("event_id", "cohort", "fraud_label", F.round("p", 6).alias("p"))


def baseline_metrics(spark, d):
    s = baseline_scores(spark, d)
    c = M.confusion(s, 0.5, "cohort")
    return c.join(M.average_precision(s, "cohort"), "cohort").join(M.roc_auc(s, "cohort"), "cohort")


def prediction_ledger(spark, d):
    ds = _dataset(spark, d)
    model = ML.fit(ds.where("cohort = 'train'"))
    return ML.ledger(model, featured(spark, d), "candidate-1", VALIDATION, TEST, TRAIN).select("event_id", "ingestion_us", "candidate_id", F.round("p", 6).alias("p"), "currency", "country", "transaction_type", "fingerprint")


def ledger_rows(spark, d):
    """The ledger without what the model and the row digest add."""
    return prediction_ledger(spark, d).drop("p", "fingerprint")


def baseline_rows(spark, d):
    """What the baseline scores, without the scores."""
    return baseline_scores(spark, d).drop("p")


_VALID = "source_id % 50 not in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 15)"

QUERIES = {
    "dedup_stream": (dedup_stream, f"{with_views()} select event_id, customer_id, amount from tx"),
    "rolling_stream": (rolling_stream, f"{_FEAT} select event_id, prior_transaction_count_5m, prior_amount_sum_10m from stat"),
    "stat_stream": (stat_stream, f"{_FEAT} select event_id, prior_amount_observation_count, {_F6('prior_amount_mean')} as prior_amount_mean, {_F6('prior_amount_stddev')} as prior_amount_stddev, {_F6('amount_zscore')} as amount_zscore, statistical_feature_status from stat"),
    "activity_stream": (activity_stream, f"{with_views()} select customer_id, count(*) as state_event_count, cast(sum(amount) as decimal(38,18)) as state_amount_total, min(event_us) as state_first_us, max(event_us) as state_latest_us from tx group by 1"),
    "risk_stream": (risk_stream, f"{_FEAT} select currency, case when prior_transaction_count_5m >= 3 or coalesce(amount_zscore >= 2.0, false) or (prior_transaction_count_5m >= 2 and coalesce(amount_zscore >= 1.0, false)) then 'REVIEW' else 'CLEAR' end as risk_disposition, count(*) as rows from stat group by 1, 2"),
    "store_retry": (store_retry, f"{with_views()} select cast(wave as bigint) as version, count(*) as rows, min(event_id) as first_id from tx group by 1"),
    "avro_roundtrip": (avro_roundtrip, f"{with_views('tx_raw')} select r.event_id, trim(r.customer_id) as customer_id, event_us, cast(r.amount as decimal(18,4)) as amount, r.currency, r.ip_address, '' as wire_error from tx_raw r join tx on tx.event_id = source_id where {_VALID}"),
    "baseline_scores": (baseline_scores, None),
    "baseline_metrics": (baseline_metrics, None),
    "prediction_ledger": (prediction_ledger, None),
    "ledger_rows": (ledger_rows, f"{with_views()} select event_id, ingestion_us, 'candidate-1' as candidate_id, currency, country, transaction_type from tx where ingestion_us >= {VALIDATION} and ingestion_us < {TEST}"),
    "baseline_rows": (baseline_rows, f"{_COHORT} select event_id, cohort, fraud_label from co where cohort in ('validation', 'test')"),
}
