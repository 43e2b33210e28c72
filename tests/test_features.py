"""Hand vectors for validation, rolling features, moments and risk."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rillflow.functions import validation as V
from rillflow.functions.canonical import duration_ms, java_hex, table_digest
from rillflow.operators import features as X
from rillflow.sources import events as E
from rillflow.sources import generator as G
from rillflow.streaming.processors import LineageError, MomentsState, RollingCore, score

T0 = 1893499200000000  # 2030-01-01T12:00:00Z
MIN = 60_000_000


def candidate(spark, **changes):
    good = G.transactions(spark, 1).first().asDict() | changes
    return spark.createDataFrame([tuple(good[n] for n in E.RAW_FIELDS)], ", ".join(f"{n} string" for n in E.RAW_FIELDS))


def errors(spark, **changes):
    return V.validate(candidate(spark, **changes)).first().errors


def test_valid_candidate_and_named_scenarios(spark):
    assert errors(spark) == []
    for r in V.validate(G.invalid_scenarios(spark)).collect():
        assert r.errors == [r.expected], r.scenario


def test_errors_accumulate(spark):
    got = errors(spark, event_id="nope", customer_id=" ", amount="0", currency="usd", country="USA", ip_address="999.1.1.1")
    assert got == ["MissingRequiredField(customer_id)", "MalformedEventId", "NonPositiveAmount", "InvalidCurrencyFormat", "InvalidCountryFormat", "InvalidIpAddressFormat"]


@pytest.mark.parametrize("amount,want", [("12.3400000", []), ("12.34567", ["AmountScaleExceeded"]), ("123456789012345.1", ["AmountPrecisionExceeded"]), ("99999999999999.9999", []), ("abc", ["MalformedAmount"]), ("-1.00", ["NonPositiveAmount"]), (" 5 ", [])])
def test_amounts(spark, amount, want):
    assert errors(spark, amount=amount) == want


def test_fail_mode_raises(spark):
    with pytest.raises(Exception, match="InvalidCurrencyFormat"):
        V.accepted(V.validate(candidate(spark, currency="usd")), "fail").collect()
    assert V.accepted(V.validate(candidate(spark, currency="usd"))).count() == 0


def tx(spark, rows):
    """rows: (id, customer, minutes, amount, currency)"""
    data = [(i, c, T0 + int(m * MIN), Decimal(a), cur, k, 0) for k, (i, c, m, a, cur) in enumerate(rows)]
    return spark.createDataFrame(data, "event_id string, customer_id string, event_us long, amount decimal(18,4), currency string, kafka_offset long, kafka_partition int")


def rolled(spark, rows):
    return {r.event_id: (r.prior_transaction_count_5m, r.prior_amount_sum_10m) for r in X.rolling(tx(spark, rows)).collect()}


def test_rolling_bounds_and_peers(spark):
    got = rolled(spark, [("a", "x", 0, "100", "USD"), ("b", "x", 3, "200", "USD"), ("c", "x", 7, "300", "USD"), ("d", "x", 10, "1", "USD")])
    assert got == {"a": (0, Decimal("0.0000")), "b": (1, Decimal("100.0000")), "c": (1, Decimal("300.0000")), "d": (1, Decimal("600.0000"))}
    got = rolled(spark, [("a", "x", 0, "10", "USD"), ("b", "x", 0, "20", "USD"), ("c", "y", 1, "7", "USD")])
    assert set(got.values()) == {(0, Decimal("0.0000"))}


def test_rolling_currency_split(spark):
    got = rolled(spark, [("a", "x", 0, "100", "USD"), ("b", "x", 1, "200", "EUR"), ("c", "x", 2, "300", "USD"), ("d", "x", 3, "400", "EUR")])
    assert got == {"a": (0, Decimal("0.0000")), "b": (1, Decimal("0.0000")), "c": (2, Decimal("100.0000")), "d": (3, Decimal("200.0000"))}
    assert rolled(spark, [("a", "x", 0, "100", "USD"), ("b", "x", 0, "500", "EUR"), ("c", "x", 10, "1", "USD")])["c"] == (0, Decimal("100.0000"))


def test_rolling_core_equals_batch(spark):
    r = random.Random(4)
    rows = [(f"e{i:03d}", "x", r.randrange(40), str(r.randrange(1, 90)), r.choice(["USD", "EUR"])) for i in range(80)]
    core = RollingCore().features({}, [(i, T0 + m * MIN, Decimal(a), c) for i, _, m, a, c in rows])
    assert {i: (n, s) for i, n, s in core} == rolled(spark, rows)


def test_late_row_sees_only_earlier_history():
    core, h = RollingCore(), {}
    first = core.features(h, [("a", T0, Decimal(100), "USD"), ("b", T0 + 5 * MIN, Decimal(200), "USD"), ("c", T0 + 10 * MIN, Decimal(300), "USD")])
    assert first[2] == ("c", 1, Decimal("300.0000"))
    assert core.features(h, [("d", T0 + 8 * MIN, Decimal(40), "USD")]) == [("d", 1, Decimal("300.0000"))]


def test_moments_vectors(spark):
    rows = [("a", "x", 0, "100", "USD"), ("b", "x", 1, "200", "USD"), ("c", "x", 2, "300", "USD"), ("d", "x", 3, "1000", "EUR")]
    got = {r.event_id: r for r in X.statistics(tx(spark, rows)).collect()}
    c = got["c"]
    assert (c.prior_amount_observation_count, c.prior_amount_mean, c.statistical_feature_status) == (2, 150.0, "READY")
    assert c.prior_amount_stddev == pytest.approx(5000**0.5) and c.amount_zscore == pytest.approx(150 / 5000**0.5)
    assert got["a"].statistical_feature_status == got["d"].statistical_feature_status == "NO_HISTORY"
    assert got["b"].statistical_feature_status == "INSUFFICIENT_VARIANCE_HISTORY" and got["b"].prior_amount_stddev is None
    equal = X.statistics(tx(spark, [(str(i), "x", i, "5", "USD") for i in range(3)])).where("event_id = '2'").first()
    assert equal.statistical_feature_status == "ZERO_VARIANCE" and equal.amount_zscore is None


def test_moments_core_and_lineage():
    s = MomentsState()
    out = [score(s, 0, i, T0 + i, Decimal(a)) for i, a in enumerate((100, 200, 300))]
    assert [o[4] for o in out] == ["NO_HISTORY", "INSUFFICIENT_VARIANCE_HISTORY", "READY"]
    assert out[2][1] == 150 and out[2][3] == pytest.approx(150 / 5000**0.5)
    with pytest.raises(LineageError):
        score(s, 1, 9, T0, Decimal(1))
    with pytest.raises(LineageError):
        score(s, 0, 2, T0, Decimal(1))


@pytest.mark.parametrize("n,z,status,velocity,want", [(3, None, "NO_HISTORY", 3, ["R001"]), (2, 0.1, "READY", 3, []), (0, 2.0, "READY", 3, ["R002"]), (0, 1.999, "READY", 3, []), (3, 1.0, "READY", 3, ["R001", "R003"]), (3, 1.0, "READY", 10, ["R003"]), (3, 2.0, "READY", 3, ["R001", "R002", "R003"]), (3, 0.999, "READY", 3, ["R001"])])
def test_risk_vectors(spark, n, z, status, velocity, want):
    policy = X.RiskPolicy("p", velocity, 2.0, 3, 1.0)
    ready = status == "READY"
    row = spark.createDataFrame([(n, 5 if ready else 0, 10.0 if ready else None, 2.0 if ready else None, z, status)], "prior_transaction_count_5m long, prior_amount_observation_count long, prior_amount_mean double, prior_amount_stddev double, amount_zscore double, statistical_feature_status string")
    got = X.decide(row, policy).first()
    assert [r[:4] for r in got.matched_rule_ids] == want and got.matched_rule_count == len(want)
    assert got.risk_disposition == ("REVIEW" if want else "CLEAR")


def test_risk_refuses_inconsistent_evidence(spark):
    row = spark.createDataFrame([(1, 5, 1.0, None, None, "READY")], "prior_transaction_count_5m long, prior_amount_observation_count long, prior_amount_mean double, prior_amount_stddev double, amount_zscore double, statistical_feature_status string")
    policy = X.RiskPolicy("p", 1, 2.0, 1, 1.0)
    with pytest.raises(Exception, match="InconsistentStatisticalContext"):
        X.decide(row, policy).collect()
    assert X.decide(row, policy, "quarantine").count() == 0
    with pytest.raises(ValueError):
        X.RiskPolicy(" p", 1, 2.0, 1, 1.0)


def test_canonical_texts(spark):
    assert [java_hex(x) for x in (2.0, 1.0, 0.1, 3.5)] == ["0x1.0p1", "0x1.0p0", "0x1.999999999999ap-4", "0x1.cp1"]
    assert [duration_ms(x) for x in ("24 hours", "10 minutes", "1 day")] == [86_400_000, 600_000, 86_400_000]
    for bad in ("0 hours", "5", "5 weeks", "-1 day"):
        with pytest.raises(ValueError):
            duration_ms(bad)
    df = spark.range(100).select("id", F.col("id").cast("string").alias("s"))
    assert table_digest(df).first() == table_digest(df.orderBy(F.desc("id"))).first()
    assert table_digest(df).first() != table_digest(df.where("id > 0")).first()


def test_sessions_and_first_occurrence(spark):
    rows = [("a", "x", 0, "1", "USD"), ("b", "x", 60, "2", "USD"), ("c", "x", 60 * 26, "3", "USD")]
    got = [(r.session, r.events) for r in X.sessions(tx(spark, rows)).orderBy("session").collect()]
    assert got == [(0, 2), (1, 1)]
    log = tx(spark, rows).withColumn("transport_us", F.col("event_us"))
    again = log.withColumns({"transport_us": F.col("event_us") + 5, "kafka_offset": F.col("kafka_offset") + 100})
    assert {r.kafka_offset for r in X.first_occurrence(log.unionByName(again)).collect()} == {0, 1, 2}
