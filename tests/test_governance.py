"""Edge cases of eligibility, policies, snapshots, graphs and publication reports."""

import threading

import pytest
from pyspark.sql import functions as F

from rillflow.operators import governance as V
from rillflow.streaming import jobs as J

GOOD = {n: v for n, v in V.FACTS.items()} | {n: "x" for n in V.TEXTS} | {"candidate_contract_version": "c", "input_schema_fingerprint": "f", "serialization_format": "s", "positive_label": 1, "compared": 5, "mismatches": 0, "round_trip_mismatches": 0}
DDL = ", ".join(f"{n} {'long' if isinstance(v, int) else 'string'}" for n, v in GOOD.items())


@pytest.mark.parametrize("change, failed", [({}, ""), ({"compared": 0}, "compared"), ({"mismatches": None}, "mismatches"), ({"round_trip_mismatches": 1}, "mismatches"), ({"outcome": None, "model_tree_sha256": ""}, "outcome,model_tree_sha256"), ({"positive_label": 0}, "positive_label")])
def test_one_failed_fact_is_enough(spark, change, failed):
    row = V.eligibility(spark.createDataFrame([tuple((GOOD | change).values())], DDL), "c", "f", "s").first()
    assert (row.failed, row.research_eligible, row.production_eligible) == (failed, failed == "", False)


def test_policy_of_null_states_and_of_none(spark):
    d = spark.createDataFrame([("a", i, None if i == 1 else "VERIFIED") for i in range(10)], "c string, position int, status string")
    row = V.policy(d, "c").first()
    assert (row.requirements, row.blocking, row.missing_evidence, row.technical_integrity_verified) == (10, 1, "", False)
    assert V.policy(d.limit(0), "c").count() == 0


def test_snapshots_with_nulls(spark):
    ddl = "struct<snapshot:string,candidate_id:string,reference_window:string,reference_membership:string,algorithm_version:string,input_contract:string,metric_configuration:string,source_table:string,source_version:long,comparison_window:string>"
    same = ("s", "c", None, "m", None, "i", "q", "t", 1, "w")
    other = ("s", "c", "x", "m", "2", "i", "q", "t", 1, None)
    d = spark.createDataFrame([(same, same), (same, other)], f"a {ddl}, b {ddl}")
    assert [(r.warnings, r.comparison_window_changed) for r in V.snapshot_differences(d).collect()] == [("", False), ("reference_population,algorithm_version", True)]


def test_graph_faults(spark):
    nodes = spark.createDataFrame([("a", "r", "x"), ("b", "r", None), ("b", "r", "x"), ("c", "", "x")], "id string, role string, reason string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("a", "gone")], "src string, dst string")
    got = {tuple(r) for r in V.graph_errors(nodes, edges).collect()}
    assert got == {("b", "REPEATED_ID"), ("b", "NO_ROLE_OR_REASON"), ("c", "NO_ROLE_OR_REASON"), ("a", "OPEN_EDGE"), ("b", "CYCLE"), ("c", "CYCLE")}
    assert V.graph_errors(nodes.limit(0), edges.limit(0)).count() == 0


def test_publication_report(spark):
    asked = spark.createDataFrame([("k1", 0), ("k2", 0), ("k3", 1)], "key string, wave int")
    got = spark.createDataFrame([("k1",), ("k1",), ("other",)], "key string")
    assert sorted(tuple(r) for r in V.publication_report(asked, got, "wave").collect()) == [(0, 2, 1, 1), (1, 1, 0, 1)]
    with pytest.raises(Exception, match="cannot be built"):
        V.publication_report(asked.withColumn("key", F.lit(None).cast("string")), got, "wave").collect()


def test_of_many_starters_one_makes_the_claim(spark, tmp_path):
    won, lost = [], []

    def start(timeout):
        try:
            won.append(J.claim(spark, f"file://{tmp_path}/c", J.StreamConfig("a", timeout=timeout), "app")["timeout_ms"])
        except ValueError:
            lost.append(timeout)

    threads = [threading.Thread(target=start, args=(t,)) for t in ("1 hour", "2 hours", "1 hour", "2 hours")]
    [t.start() for t in threads], [t.join() for t in threads]
    assert len(won) == len(lost) == 2 and len(set(won)) == 1
