"""Whether candidates, policies, snapshots, graphs and publications are what they must be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a manifest of a candidate for research must say.
FACTS = {
    "validation_status": "TECHNICALLY_VERIFIED",
    "positive_meaning": "FRAUD",
    "outcome": "EQUIVALENT",
    "data_origin": "synthetic",
    "evaluation_scope": "integration_verification",
    "production_fraud_quality": "unproven",
}
# Text that a manifest must have.
TEXTS = ["candidate_id", "training_run_id", "source_mlflow_run_id", "dataset_snapshot_id", "dataset_logical_fingerprint", "source_schema_fingerprint", "model_tree_sha256"]


def eligibility(manifests: DataFrame, contract: str, fingerprint: str, serialization: str) -> DataFrame:
    """Of each manifest the facts and texts that fail, in their order; one without any may be registered for research.

    A null is a failure. Nothing here makes a candidate eligible for production.
    """
    want = {"candidate_contract_version": contract, "input_schema_fingerprint": fingerprint, "serialization_format": serialization} | FACTS
    checks = [(n, F.col(n) == v) for n, v in want.items()]
    checks += [("positive_label", F.col("positive_label") == 1), ("compared", F.col("compared") > 0), ("mismatches", (F.col("mismatches") == 0) & F.col("round_trip_mismatches").eqNullSafe(F.col("mismatches")))]
    checks += [(n, F.trim(n) != "") for n in TEXTS]
    failed = F.filter(F.array(*[F.when(F.coalesce(ok, F.lit(False)), None).otherwise(F.lit(n)) for n, ok in checks]), lambda x: x.isNotNull())
    d = manifests.withColumn("failed", F.array_join(failed, ","))
    return d.select("candidate_id", "failed", (F.col("failed") == "").alias("research_eligible"), F.lit(False).alias("production_eligible"))


def policy(states: DataFrame, by: str, integrity: int = 3) -> DataFrame:
    """states (by, position, status) of a candidate's requirements: how many block, which lack evidence (their positions) and
    whether the first `integrity` ones hold. No candidate is ever ready for promotion."""
    blocks = F.coalesce(F.col("status") != "VERIFIED", F.lit(True))
    lacking = F.array_sort(F.collect_list(F.when(F.col("status") == "NOT_ESTABLISHED", F.col("position"))))  # one for each requirement
    return states.groupBy(by).agg(
        F.count("*").alias("requirements"),
        F.count(F.when(blocks, 1)).alias("blocking"),
        F.array_join(lacking.cast("array<string>"), ",").alias("missing_evidence"),
        (F.count(F.when((F.col("position") < integrity) & blocks, 1)) == 0).alias("technical_integrity_verified"),
        F.lit("NOT_ELIGIBLE_FOR_PROMOTION").alias("readiness"),
    )


# The facets of a drift snapshot and the columns that make each.
FACETS = {
    "candidate_identity": ["candidate_id"],
    "reference_population": ["reference_window", "reference_membership"],
    "algorithm_version": ["algorithm_version"],
    "feature_contract": ["input_contract"],
    "metric_configuration": ["metric_configuration"],
    "delta_source": ["source_table", "source_version"],
}


def snapshot_differences(pairs: DataFrame) -> DataFrame:
    """pairs (a: struct, b: struct) of snapshots: the facets in which they differ (a null equals a null), in order."""
    differ = {n: ~F.forall(F.array(*[F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in cs]), lambda x: x) for n, cs in FACETS.items()}
    names = F.filter(F.array(*[F.when(x, F.lit(n)) for n, x in differ.items()]), lambda x: x.isNotNull())
    moved = ~F.col("a.comparison_window").eqNullSafe(F.col("b.comparison_window"))
    return pairs.select(F.col("a.snapshot").alias("first_snapshot"), F.col("b.snapshot").alias("second_snapshot"), F.array_join(names, ",").alias("warnings"), moved.alias("comparison_window_changed"))


def graph_errors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Faults of a dependency graph, nodes (id, role, reason) and edges (src, dst): REPEATED_ID, NO_ROLE_OR_REASON, OPEN_EDGE
    (its end is no node) and CYCLE (on or behind one), each with its node."""
    from .transport import cycle_nodes

    spark = nodes.sparkSession
    blank = F.coalesce(F.trim("role"), F.lit("")).eqNullSafe("") | F.coalesce(F.trim("reason"), F.lit("")).eqNullSafe("")
    fault = lambda d, what: d.select(F.col("id").alias("node"), F.lit(what).alias("error"))
    twice = nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    open_ = edges.join(nodes.select("id").distinct(), F.col("dst") == F.col("id"), "left_anti").select(F.col("src").alias("id")).distinct()
    loops = cycle_nodes(spark, edges.select("src", "dst")).withColumnRenamed("node", "id")
    return fault(twice, "REPEATED_ID").unionByName(fault(nodes.where(blank), "NO_ROLE_OR_REASON")).unionByName(fault(open_, "OPEN_EDGE")).unionByName(fault(loops, "CYCLE"))


def publication_report(requested: DataFrame, delivered: DataFrame, by: str) -> DataFrame:
    """requested (key, by) against delivered (key): how many were asked for, acknowledged and failed. A record without a key
    cannot be built and fails the job before anything is counted; a key delivered twice is acknowledged once."""
    from .journals import refuse

    built = requested.where(refuse(F.col("key").isNull(), "a record cannot be built"))
    d = built.join(delivered.select("key").distinct().withColumn("_ok", F.lit(1)), "key", "left")
    return d.groupBy(by).agg(F.count("*").alias("requested"), F.count("_ok").alias("acknowledged"), (F.count("*") - F.count("_ok")).alias("failed"))
