"""Hand vectors for labels, feedback, metrics and drift."""

import pytest

from rillflow.operators import monitoring as M
from rillflow.operators import transport as T


def side(spark, a, b):
    rows = [("reference", None if x is None else float(x)) for x in a] + [("comparison", None if x is None else float(x)) for x in b]
    return spark.createDataFrame(rows, "side string, x double")


@pytest.mark.parametrize("a,b,want", [([1, 2, 2, 3], [2, 3, 1, 2], 0.0), ([1, 1, 2], [8, 9], 1.0), ([1, 2], [1, 1, 1, 2], 0.25), ([3, 3, 3], [3, 3], 0.0)])
def test_ks(spark, a, b, want):
    assert M.ks_distance(side(spark, a, b)).first().ks == want


def test_ks_empty(spark):
    r = M.ks_distance(side(spark, [None], [1])).first()
    assert r.ks is None and r.ks_status == "EMPTY_NON_NULL_COHORT"


def test_psi(spark):
    r = M.psi(side(spark, [7, 7, 7], [7, 8])).first()
    assert (r.psi_status, r.psi) == ("DEGENERATE_REFERENCE", None)
    r = M.psi(side(spark, [0] * 4 + [10] * 4, [0] * 2 + [10] * 2), 4).first()
    assert (r.effective_bins, r.psi_status, r.psi) == (2, "AVAILABLE", 0.0)
    assert M.psi(side(spark, range(4), range(4)), 2).first().psi == 0.0


def test_numeric_summary(spark):
    r = M.numeric_summary(spark.createDataFrame([(None,), (1.0,), (2.0,), (3.0,), (4.0,), (5.0,)], "x double")).first()
    assert (r.rows, r.nulls, r.missing_fraction, r["mean"], r["median"], r.p05, r.p95) == (6, 1, 0.166667, 3.0, 3.0, 1.2, 4.8)


def test_categorical(spark):
    d = spark.createDataFrame([("reference", "USD"), ("comparison", "EUR"), ("comparison", "EUR")], "side string, x string")
    r = M.categorical_shift(d).first()
    assert (r.total_variation, r.jensen_shannon, r.new_categories, r.disappeared_categories) == (1.0, 1.0, 1, 1)
    d = spark.createDataFrame([("reference", None), ("reference", "USD"), ("comparison", None), ("comparison", None)], "side string, x string")
    assert {(r.category, r.comparison_count) for r in M.category_changes(d).collect()} == {("<MISSING>", 2), ("USD", 0)}


def test_ranking_metrics_with_ties(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.5, 0), (0.5, 1), (0.1, 0)]
    d = spark.createDataFrame(rows, "p double, fraud_label int")
    assert M.average_precision(d).first().average_precision == 0.755556
    assert M.roc_auc(d).first().roc_auc == 0.777778
    c = M.confusion(d).first()
    assert (c.tp, c.fp, c.fn, c.tn) == (3, 2, 0, 1)


def test_labels_asof_takes_the_latest_observed_revision(spark):
    d = spark.createDataFrame([("a", "FRAUD", 10, "s", 1), ("a", "LEGIT", 20, "s", 2)], "event_id string, outcome string, observed_us long, label_source string, revision long")
    assert [M.labels_asof(d, t).first()["outcome"] for t in (10, 19, 20)] == ["FRAUD", "FRAUD", "LEGIT"]
    assert M.labels_asof(d, 9).count() == 0


def test_feedback_needs_every_predecessor(spark):
    rows = [("p", "c", "e", 1, "CONFIRMED_FRAUD", 2), ("p", "c", "e", 2, "PENDING", 7), ("p", "c", "e", 3, "CONFIRMED_LEGIT", 5)]
    fb = spark.createDataFrame(rows, "provider_id string, provider_case_id string, event_id string, source_revision long, status string, received_us long")
    u = spark.createDataFrame([("e",), ("other",)], "event_id string")
    at = lambda t: {r.event_id: r.state for r in M.feedback_resolved(u, fb, t).collect()}
    assert at(1) == {"e": "NOT_YET_OBSERVED", "other": "NO_CASE"}
    assert at(5)["e"] == "FRAUD" and at(8)["e"] == "LEGIT"
    both = fb.unionByName(spark.createDataFrame([("q", "d", "e", 1, "CONFIRMED_FRAUD", 1)], fb.schema))
    assert {r.event_id: r.state for r in M.feedback_resolved(u, both, 9).collect()}["e"] == "AMBIGUOUS"


def test_version_diff_and_visibility(spark):
    v = spark.createDataFrame([("a", 0, "f"), ("b", 0, "f"), ("c", 1, "f"), ("d", 3, "f"), ("e", 3, "f")], "event_id string, version long, fingerprint string")
    seg = T.commit_segments(v, 3).orderBy("version").collect()
    assert [(r.added, r.visible) for r in seg] == [(2, 2), (1, 3), (0, 3), (2, 5)]
    assert sorted(r.first_version for r in T.first_visible(v).collect()) == [0, 0, 1, 3, 3]
    d = T.version_diff(T.read_version(v, 0), T.read_version(v, 1)).groupBy("change").count().collect()
    assert {r.change: r["count"] for r in d} == {"SAME": 2, "ADDED": 1}


def test_reconcile_and_parity(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "event_id long")
    r = {x.stage: x for x in T.stage_reconcile({"plan": ids(1, 2, 3), "b": ids(2, 2, 9)}).collect()}
    assert (r["b"]["rows"], r["b"].distinct_keys, r["b"].missing, r["b"].unexpected) == (3, 2, 2, 1)
    p = spark.createDataFrame([(1, 0.5), (2, 0.25)], "event_id long, p double")
    q = spark.createDataFrame([(1, 0.5), (3, 0.1)], "event_id long, p double")
    x = T.parity(p, q).first()
    assert (x.compared, x.missing, x.unexpected, x.mismatched) == (1, 1, 1, 0)


def test_lineage_deeper_than_64_levels(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(66)], "src string, dst string")
    assert {r.node: r.depth for r in T.closure(spark, chain, "n0").collect()} == {f"n{i}": i for i in range(67)}
    assert T.cycle_nodes(spark, chain).count() == 0
