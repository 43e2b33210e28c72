"""Strictly prior features per customer: rolling counts and currency-safe sums, running moments, risk decisions.

One shuffle on the customer serves all windows: the currency windows are partitioned by (customer, currency), which a
partitioning by customer already satisfies, so wide tables are exchanged once.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import java_hex
from ..functions.validation import statistical_errors

MINUTE_US = 60_000_000
SD_FLOOR = 1e-12


def prior_count(us: str, micros: int, *keys: str) -> Column:
    """Rows of the key in [t - micros, t): the lower bound counts, rows of the same instant do not."""
    return F.count("*").over(Window.partitionBy(*keys).orderBy(us).rangeBetween(-micros, -1))


def prior_sum(value: str, us: str, micros: int, *keys: str) -> Column:
    total = F.sum(value).over(Window.partitionBy(*keys).orderBy(us).rangeBetween(-micros, -1))
    return F.coalesce(total, F.lit(0)).cast("decimal(38,4)")


def rolling(tx: DataFrame, count_us: int = 5 * MINUTE_US, sum_us: int = 10 * MINUTE_US, customer: str = "customer_id", currency: str = "currency", us: str = "event_us", amount: str = "amount") -> DataFrame:
    """tx with prior_transaction_count_5m (all currencies) and prior_amount_sum_10m (the row's own currency)."""
    return tx.withColumns({"prior_transaction_count_5m": prior_count(us, count_us, customer), "prior_amount_sum_10m": prior_sum(amount, us, sum_us, customer, currency)})


def wave_rolling(tx: DataFrame, count_us: int, sum_us: int, bucket_us: int | None = None) -> DataFrame:
    """Rolling features where only rows of the same or an earlier wave have been seen.

    A range self-join made an equi-join: each row looks up its own and the preceding time buckets, as long as the longer
    window, so a customer's rows meet only those of two buckets.
    """
    size = bucket_us or max(count_us, sum_us)
    if size < max(count_us, sum_us):
        raise ValueError("a bucket is at least a window long")
    b = F.floor(F.col("event_us") / size)
    new = tx.select("event_id", "customer_id", "currency", "event_us", "wave", F.explode(F.array(b, b - 1)).alias("bucket"))
    old = tx.select(F.col("customer_id"), F.col("currency").alias("old_currency"), F.col("event_us").alias("old_us"), F.col("wave").alias("old_wave"), "amount", b.alias("bucket"))
    gap = F.col("event_us") - F.col("old_us")
    seen = new.join(old, ["customer_id", "bucket"]).where((gap >= 1) & (gap <= max(count_us, sum_us)) & (F.col("old_wave") <= F.col("wave")))
    out = seen.groupBy("event_id").agg(F.count(F.when(gap <= count_us, 1)).alias("n"), F.sum(F.when((gap <= sum_us) & (F.col("currency") == F.col("old_currency")), F.col("amount"))).alias("s"))
    cols = [F.coalesce("n", F.lit(0)).cast("long").alias("prior_transaction_count_5m"), F.coalesce("s", F.lit(0)).cast("decimal(38,4)").alias("prior_amount_sum_10m")]
    return tx.join(out, "event_id", "left").select(*tx.columns, *cols)


def statistics(tx: DataFrame, customer: str = "customer_id", currency: str = "currency", amount: str = "amount") -> DataFrame:
    """tx with prior moments per customer and currency in transport order, z-score and status."""
    w = Window.partitionBy(customer, currency).orderBy("kafka_partition", "kafka_offset").rowsBetween(Window.unboundedPreceding, -1)
    x = F.col(amount).cast("double")
    d = tx.withColumns({"prior_amount_observation_count": F.count("*").over(w), "__m": F.avg(x).over(w), "__s": F.stddev_samp(x).over(w)})
    n = F.col("prior_amount_observation_count")
    d = d.withColumns({"prior_amount_mean": F.when(n >= 1, F.col("__m")), "prior_amount_stddev": F.when(n >= 2, F.col("__s"))})
    s, m = F.col("prior_amount_stddev"), F.col("prior_amount_mean")
    status = F.when(n == 0, "NO_HISTORY").when(n == 1, "INSUFFICIENT_VARIANCE_HISTORY").when(s <= SD_FLOOR, "ZERO_VARIANCE").otherwise("READY")
    return d.withColumns({"amount_zscore": F.when((n >= 2) & (s > SD_FLOOR), (x - m) / s), "statistical_feature_status": status}).drop("__m", "__s")


def lineage_violations(tx: DataFrame, customer: str = "customer_id", currency: str = "currency") -> DataFrame:
    """Rows whose key changes partition or whose offset does not increase, in arrival order."""
    w = Window.partitionBy(customer, currency).orderBy("transport_us", "kafka_offset")
    d = tx.withColumns({"last_partition": F.lag("kafka_partition").over(w), "last_offset": F.lag("kafka_offset").over(w)})
    return d.where((F.col("last_partition") != F.col("kafka_partition")) | (F.col("last_offset") >= F.col("kafka_offset")))


@dataclass(frozen=True)
class RiskPolicy:
    """Explicit thresholds; all are given, none has a default."""

    version: str
    high_velocity: int
    high_zscore: float
    combined_velocity: int
    combined_zscore: float

    def __post_init__(self):
        if not self.version or self.version != self.version.strip() or any(ord(c) < 32 or ord(c) == 127 for c in self.version):
            raise ValueError("a policy version is trimmed text without control characters")
        if self.high_velocity < 1 or self.combined_velocity < 1:
            raise ValueError("velocities are 1 or more")
        if not all(0 < z < float("inf") for z in (self.high_zscore, self.combined_zscore)):
            raise ValueError("z-scores are positive and finite")

    @property
    def fingerprint(self) -> str:
        """Digest of the policy's canonical text (a fixed format)."""
        (r1, c1), (r2, c2), (r3, c3) = RULES
        lines = [
            "decision_logic_version=deterministic-risk-v1",
            f"policy_version={len(self.version.encode())}:{self.version}",
            "decision_mapping=no_matches:CLEAR;any_match:REVIEW",
            f"{r1}|{c1}|prior_transaction_count_5m>={self.high_velocity}",
            f"{r2}|{c2}|status=READY;z_present;amount_zscore>={java_hex(self.high_zscore)}",
            f"{r3}|{c3}|status=READY;z_present;prior_transaction_count_5m>={self.combined_velocity};amount_zscore>={java_hex(self.combined_zscore)}",
        ]
        return hashlib.sha256("".join(x + "\n" for x in lines).encode()).hexdigest()


# Rule ids and reasons, in order.
RULES = (("R001_HIGH_TRANSACTION_VELOCITY_5M", "HIGH_TRANSACTION_VELOCITY_5M"), ("R002_HIGH_AMOUNT_ZSCORE", "HIGH_AMOUNT_ZSCORE"), ("R003_VELOCITY_AND_AMOUNT_ANOMALY", "VELOCITY_AND_AMOUNT_ANOMALY"))


def risk_input_errors() -> Column:
    n, c = F.col("prior_transaction_count_5m"), F.col("prior_amount_observation_count")
    finite = lambda x: F.isnan(F.col(x)) | F.abs(F.col(x)).isin(float("inf"))
    parts = [F.when(n < 0, "NegativeCount(prior_transaction_count_5m)"), F.when(c < 0, "NegativeCount(prior_amount_observation_count)")]
    parts += [F.when(finite(x), f"NonFiniteValue({x})") for x in ("prior_amount_mean", "prior_amount_stddev", "amount_zscore")]
    parts += [F.when(F.col("prior_amount_stddev") < 0, "NegativeStandardDeviation"), F.when(statistical_errors(), "InconsistentStatisticalContext")]
    parts += [F.when(F.col(x).isNull(), f"MissingRequiredFeature({x})") for x in ("prior_transaction_count_5m", "prior_amount_observation_count", "statistical_feature_status")]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def decide(features: DataFrame, policy: RiskPolicy, mode: str = "fail") -> DataFrame:
    """features with the six decision columns; a row is otherwise unchanged. mode 'fail': inconsistent evidence fails the
    job; 'quarantine': such rows are left out."""
    if mode not in ("fail", "quarantine"):
        raise ValueError("mode is fail or quarantine")
    n, z, ready = F.col("prior_transaction_count_5m"), F.col("amount_zscore"), F.col("statistical_feature_status") == "READY"
    hits = [n >= policy.high_velocity, ready & (z >= policy.high_zscore), ready & (n >= policy.combined_velocity) & (z >= policy.combined_zscore)]
    pick = lambda i: F.filter(F.array(*[F.when(h, r[i]) for h, r in zip(hits, RULES, strict=True)]), lambda x: x.isNotNull())
    d = features.withColumn("__e", risk_input_errors())
    if mode == "fail":
        d = d.where(F.when(F.size("__e") == 0, True).otherwise(F.raise_error(F.concat_ws(",", "__e")).cast("boolean")))
    else:
        d = d.where(F.size("__e") == 0)
    return d.withColumns(
        {
            "risk_disposition": F.when(F.size(pick(0)) == 0, "CLEAR").otherwise("REVIEW"),
            "policy_version": F.lit(policy.version),
            "policy_fingerprint": F.lit(policy.fingerprint),
            "matched_rule_ids": pick(0),
            "reason_codes": pick(1),
            "matched_rule_count": F.size(pick(0)),
        }
    ).drop("__e")


def first_occurrence(log: DataFrame, key: str = "event_id") -> DataFrame:
    """One row per key: the first in transport order. A combining aggregate, so a key with many copies is no hot spot."""
    rest = [c for c in log.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct("transport_us", "kafka_partition", "kafka_offset"))
    return log.groupBy(key).agg(first.alias("__r")).select(key, "__r.*").select(*log.columns)


def activity(tx: DataFrame, timeout_us: int = 24 * 60 * MINUTE_US) -> DataFrame:
    """Per customer: count, total, first and latest event and expiry, as one batch over new state would leave them."""
    return tx.groupBy("customer_id").agg(F.count("*").alias("state_event_count"), F.sum("amount").cast("decimal(38,18)").alias("state_amount_total"), F.min("event_us").alias("first_us"), F.max("event_us").alias("latest_us"), (F.max("event_us") + timeout_us).alias("expiry_us"))


def sessions(tx: DataFrame, timeout_us: int = 24 * 60 * MINUTE_US) -> DataFrame:
    """Activity lifetimes: a session ends when a customer is silent for timeout_us or longer."""
    w = Window.partitionBy("customer_id").orderBy("event_us", "event_id")
    new = F.coalesce((F.col("event_us") - F.lag("event_us").over(w) >= timeout_us).cast("int"), F.lit(0))
    d = tx.withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return d.groupBy("customer_id", "session").agg(F.count("*").alias("events"), F.sum("amount").cast("decimal(38,4)").alias("total"), F.min("event_us").alias("first_us"), F.max("event_us").alias("latest_us"))
