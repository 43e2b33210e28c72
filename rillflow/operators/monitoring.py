"""Point-in-time labels, datasets, cohorts, quality metrics, delayed outcomes, feedback and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
MIN_ROWS, MIN_CLASS = 20, 2


def ratio(a: Column, b: Column) -> Column:
    """a / b as doubles, null where b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


# -- labels and datasets ---------------------------------------------------------------------------------------------


def labels_asof(labels: DataFrame, asof_us: int) -> DataFrame:
    """The latest revision of each event observed by the cut-off (max_by combines before the shuffle)."""
    cols = [c for c in labels.columns if c != "event_id"]
    return labels.where(F.col("observed_us") <= asof_us).groupBy("event_id").agg(F.max_by(F.struct(*cols), "revision").alias("r")).select("event_id", "r.*")


def label_history_errors(labels: DataFrame) -> DataFrame:
    """Per event: revisions that are not 1..n, and observations that go back in time."""
    w = Window.partitionBy("event_id").orderBy("revision")
    d = labels.withColumns({"gap": (F.col("revision") != F.row_number().over(w)).cast("int"), "back": F.coalesce((F.col("observed_us") < F.lag("observed_us").over(w)).cast("int"), F.lit(0))})
    return d.groupBy("event_id").agg(F.count("*").alias("revisions"), F.sum("gap").cast("long").alias("gaps"), F.sum("back").cast("long").alias("backwards"))


def dataset_asof(features: DataFrame, labels: DataFrame, asof_us: int) -> DataFrame:
    """Features known by the cut-off with their selected label (fraud_label 0/1); unlabelled rows are left out."""
    chosen = labels_asof(labels, asof_us).select("event_id", (F.col("outcome") == "FRAUD").cast("int").alias("fraud_label"), "observed_us", "label_source", "revision")
    return features.where(F.col("ingestion_us") <= asof_us).join(chosen, "event_id")


def dataset_counts(features: DataFrame, labels: DataFrame, asof_us: int) -> DataFrame:
    """One row: rows in and out, and what makes a build fail (labels before ingestion, labels without features)."""
    known = features.where(F.col("ingestion_us") <= asof_us).select("event_id", "ingestion_us")
    d = known.join(labels_asof(labels, asof_us), "event_id", "full_outer")
    return d.agg(
        F.count("ingestion_us").alias("features"),
        F.count("outcome").alias("labels"),
        F.count(F.when(F.col("ingestion_us").isNotNull() & F.col("outcome").isNotNull(), 1)).alias("labelled"),
        F.count(F.when(F.col("outcome").isNull(), 1)).alias("unlabelled"),
        F.count(F.when(F.col("ingestion_us").isNull(), 1)).alias("without_features"),
        F.count(F.when(F.col("observed_us") < F.col("ingestion_us"), 1)).alias("before_ingestion"),
    )


def split_of(train_end: int, validation_end: int, test_end: int, us: str = "ingestion_us") -> Column:
    t = F.col(us)
    return F.when(t < train_end, "train").when(t < validation_end, "validation").when(t < test_end, "test").otherwise("outside")


def temporal_cohorts(dataset: DataFrame, train_end: int, validation_end: int, test_end: int) -> DataFrame:
    """dataset with its cohort; a training row whose label came after the cohort's end is 'label_delayed'."""
    split = split_of(train_end, validation_end, test_end)
    late = (split == "train") & (F.col("observed_us") > train_end)
    return dataset.withColumn("cohort", F.when(late, "label_delayed").otherwise(split))


def class_weights(cohorts: DataFrame) -> DataFrame:
    """Rows and balanced weight n / (2 * rows of the class) by cohort and label."""
    per = cohorts.groupBy("cohort", "fraud_label").agg(F.count("*").alias("rows"))
    total = F.sum("rows").over(Window.partitionBy("cohort"))
    return per.select("cohort", "fraud_label", "rows", F.round(total.cast("double") / (2.0 * F.col("rows").cast("double")) + 1e-9, 6).alias("weight"))


def cohort_quality(tx: DataFrame, labels: DataFrame, train_end: int, validation_end: int, test_end: int, asof_us: int) -> DataFrame:
    """Per cohort: events, customers (new ones against earlier cohorts), labelled by outcome and delay, eligible for fitting."""
    split = split_of(train_end, validation_end, test_end)
    index = F.when(split == "train", 0).when(split == "validation", 1).when(split == "test", 2)
    d = tx.withColumn("cohort", split).withColumn("idx", index).where("idx is not null")
    d = d.join(labels_asof(labels, asof_us).select("event_id", "outcome", "observed_us"), "event_id", "left")
    first = d.groupBy("customer_id").agg(F.min("idx").alias("first_idx"))
    new = d.select("customer_id", "cohort", "idx").distinct().join(first, "customer_id").groupBy("cohort").agg(F.count("*").alias("customers"), F.count(F.when(F.col("idx") == F.col("first_idx"), 1)).alias("new_customers"))
    has = F.col("outcome").isNotNull()
    fit = has & ((F.col("cohort") != "train") | (F.col("observed_us") <= train_end))
    counts = d.groupBy("cohort").agg(
        F.count("*").alias("events"),
        F.count(F.when(has, 1)).alias("labelled"),
        F.count(F.when(F.col("outcome") == "FRAUD", 1)).alias("fraud"),
        F.count(F.when(F.col("outcome") == "LEGIT", 1)).alias("legit"),
        F.count(F.when(has & (F.col("observed_us") - F.col("ingestion_us") <= 24 * HOUR_US), 1)).alias("short_delay"),
        F.count(F.when(has & (F.col("observed_us") - F.col("ingestion_us") > 24 * HOUR_US), 1)).alias("long_delay"),
        F.count(F.when(fit, 1)).alias("eligible"),
    )
    return counts.join(new, "cohort")


# -- quality metrics -------------------------------------------------------------------------------------------------


def confusion(scored: DataFrame, threshold: float = 0.5, *keys: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and F1 of p >= threshold against fraud_label."""
    hit, pos = F.col("p") >= threshold, F.col("fraud_label") == 1
    d = scored.groupBy(*keys).agg(*[F.count(F.when(c, 1)).alias(n) for n, c in (("tp", hit & pos), ("fp", hit & ~pos), ("fn", ~hit & pos), ("tn", ~hit & ~pos))])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    r6 = lambda c: F.round(c + 1e-9, 6)
    return d.select(*keys, "tp", "fp", "fn", "tn", r6(ratio(tp, tp + fp)).alias("precision"), r6(ratio(tp, tp + fn)).alias("recall"), r6(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"))


def by_score(scored: DataFrame, *keys: str) -> DataFrame:
    """Positives and rows of each distinct score: what the ranking metrics need, whatever the number of rows."""
    return scored.groupBy(*keys, "p").agg(F.sum("fraud_label").cast("long").alias("pos"), F.count("*").alias("n"))


def average_precision(scored: DataFrame, *keys: str) -> DataFrame:
    """Step sum over distinct scores: recall gained times precision so far. Windows run over scores, not rows."""
    w = Window.partitionBy(*keys).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    d = by_score(scored, *keys).withColumns({"ctp": F.sum("pos").over(w), "cn": F.sum("n").over(w), "np": F.sum("pos").over(Window.partitionBy(*keys))})
    term = ratio(F.col("pos"), F.col("np")) * ratio(F.col("ctp"), F.col("cn"))
    return d.groupBy(*keys).agg(F.round(F.sum(term) + 1e-9, 6).alias("average_precision"))


def roc_auc(scored: DataFrame, *keys: str) -> DataFrame:
    """Mann-Whitney with ties at one half, from counts by score."""
    below = Window.partitionBy(*keys).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    d = by_score(scored, *keys).withColumn("neg", F.col("n") - F.col("pos")).withColumn("under", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    won = F.sum(F.col("pos").cast("double") * (F.col("under").cast("double") + F.col("neg").cast("double") / 2.0))
    return d.groupBy(*keys).agg(F.round(ratio(won, F.sum("pos").cast("double") * F.sum("neg").cast("double")) + 1e-9, 6).alias("roc_auc"))


def gate(rows: Column, positives: Column, min_rows: int = MIN_ROWS, min_class: int = MIN_CLASS) -> Column:
    return F.when(rows < min_rows, "INSUFFICIENT_ROWS").when(F.least(positives, rows - positives) < min_class, "INSUFFICIENT_CLASS_SUPPORT").otherwise("AVAILABLE")


def segment_metrics(scored: DataFrame, dimensions: list[str], min_rows: int = MIN_ROWS, min_class: int = MIN_CLASS) -> DataFrame:
    """Confusion metrics for every value of each dimension, in one pass over unpivoted rows that combine map-side."""
    long = scored.select("p", "fraud_label", F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in dimensions])).alias("s")).select("p", "fraud_label", "s.*")
    d = confusion(long, 0.5, "dimension", "value")
    rows, pos = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), F.col("tp") + F.col("fn")
    return d.withColumn("support", gate(rows, pos, min_rows, min_class))


def outcome_coverage(predictions: DataFrame, labels: DataFrame, asof_us: int) -> DataFrame:
    """One row: scored, labelled, coverage, revisions, and the delay of labels in hours and buckets."""
    d = predictions.join(labels_asof(labels, asof_us), "event_id", "left")
    h = (F.col("observed_us") - F.col("ingestion_us")).cast("double") / float(HOUR_US)
    return d.agg(
        F.count("*").alias("scored"),
        F.count("outcome").alias("labelled"),
        F.round(ratio(F.count("outcome"), F.count("*")) + 1e-9, 6).alias("coverage"),
        F.count(F.when(F.col("revision") == 1, 1)).alias("first_revision"),
        F.count(F.when(F.col("revision") > 1, 1)).alias("later_revision"),
        F.round(F.min(h) + 1e-9, 6).alias("delay_min"),
        F.round(F.percentile(h, F.lit(0.5)) + 1e-9, 6).alias("delay_median"),
        F.round(F.max(h) + 1e-9, 6).alias("delay_max"),
        F.count(F.when(h < 24, 1)).alias("under_24h"),
        F.count(F.when((h >= 24) & (h < 168), 1)).alias("under_7d"),
        F.count(F.when(h >= 168, 1)).alias("over_7d"),
    )


def outcome_compare(predictions: DataFrame, labels: DataFrame, first_us: int, second_us: int) -> DataFrame:
    """How selected outcomes changed between two cut-offs: NEW, REVISED, FLIPPED, UNCHANGED, LOST or UNLABELLED."""
    a = labels_asof(labels, first_us).select("event_id", F.col("outcome").alias("oa"), F.col("revision").alias("ra"))
    b = labels_asof(labels, second_us).select("event_id", F.col("outcome").alias("ob"), F.col("revision").alias("rb"))
    d = predictions.select("event_id").join(a, "event_id", "left").join(b, "event_id", "left")
    change = F.when(F.col("oa").isNull() & F.col("ob").isNull(), "UNLABELLED").when(F.col("oa").isNull(), "NEW").when(F.col("ob").isNull(), "LOST").when(F.col("oa") != F.col("ob"), "FLIPPED").when(F.col("ra") != F.col("rb"), "REVISED").otherwise("UNCHANGED")
    return d.select("event_id", change.alias("change"))


# -- feedback --------------------------------------------------------------------------------------------------------


def feedback_available(records: DataFrame) -> DataFrame:
    """records with available_us: a revision counts once every predecessor has been received (running maximum)."""
    w = Window.partitionBy("provider_id", "provider_case_id").orderBy("source_revision").rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("available_us", F.max("received_us").over(w))


def feedback_resolved(universe: DataFrame, records: DataFrame, asof_us: int) -> DataFrame:
    """Each event's effective state at the cut-off, by precedence over the providers' selected revisions."""
    cases = feedback_available(records).groupBy("provider_id", "provider_case_id").agg(F.max_by("event_id", "source_revision").alias("event_id"), F.max(F.when(F.col("available_us") <= asof_us, F.struct("source_revision", "status"))).alias("sel"))
    has = lambda s: F.max((F.col("sel.status") == s).cast("int"))
    per = cases.groupBy("event_id").agg(F.count("*").alias("cases"), *[F.coalesce(has(s), F.lit(0)).alias(a) for s, a in (("CONFIRMED_FRAUD", "f"), ("CONFIRMED_LEGIT", "l"), ("RETRACTED", "r"), ("PENDING", "q"))])
    d = universe.join(per, "event_id", "left")
    state = F.when((F.col("f") == 1) & (F.col("l") == 1), "AMBIGUOUS").when(F.col("f") == 1, "FRAUD").when(F.col("l") == 1, "LEGIT").when(F.col("r") == 1, "RETRACTED").when(F.col("q") == 1, "PENDING").when(F.col("cases") > 0, "NOT_YET_OBSERVED").otherwise("NO_CASE")
    return d.select(*universe.columns, state.alias("state"), F.coalesce("cases", F.lit(0)).alias("cases"))


def feedback_errors(records: DataFrame, universe: DataFrame) -> DataFrame:
    """One row of counts of what an ingestion refuses: unknown events, receipts before ingestion, broken histories."""
    w = Window.partitionBy("provider_id", "provider_case_id").orderBy("source_revision")
    d = records.select("provider_id", "provider_case_id", "provider_record_id", "event_id", "source_revision", "received_us").join(universe.select("event_id", F.col("ingestion_us").alias("known_us")), "event_id", "left")
    d = d.withColumns({"gap": F.row_number().over(w) != F.col("source_revision"), "moved": F.coalesce(F.lag("event_id").over(w) != F.col("event_id"), F.lit(False))})
    return d.agg(
        F.count("*").alias("records"),
        F.count(F.when(F.col("known_us").isNull(), 1)).alias("unknown_events"),
        F.count(F.when(F.col("received_us") < F.col("known_us"), 1)).alias("before_ingestion"),
        F.count(F.when(F.col("gap"), 1)).alias("revision_gaps"),
        F.count(F.when(F.col("moved"), 1)).alias("moved_cases"),
    )


def feedback_merge(base: DataFrame, batch: DataFrame) -> DataFrame:
    """Per delivery key: rows, distinct payloads and what happens: NEW, KNOWN, DUPLICATE (dropped) or CONFLICT (refused)."""
    payload = F.sha2(F.concat_ws("|", "event_id", "source_revision", "status", "received_us"), 256)
    d = base.select("provider_record_id", payload.alias("h"), F.lit(1).alias("old")).unionByName(batch.select("provider_record_id", payload.alias("h"), F.lit(0).alias("old")))
    g = d.groupBy("provider_record_id").agg(F.count("*").alias("deliveries"), F.countDistinct("h").alias("payloads"), F.max("old").alias("o"))
    what = F.when(F.col("payloads") > 1, "CONFLICT").when(F.col("deliveries") > 1, "DUPLICATE").when(F.col("o") == 1, "KNOWN").otherwise("NEW")
    return g.select("provider_record_id", "deliveries", "payloads", what.alias("resolution"))


# -- drift -----------------------------------------------------------------------------------------------------------


def unpivot(df: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """(keys, feature, x): numeric columns as doubles, one row each."""
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("u")).select(*keys, "u.*")


def numeric_summary(long: DataFrame, *keys: str) -> DataFrame:
    """Rows, nulls, range, mean, and type-7 quantiles of x."""
    q = F.percentile("x", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    d = long.groupBy(*keys).agg(F.count("*").alias("rows"), F.count("x").alias("non_null"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean"), q.alias("q"))
    r6 = lambda c: F.round(c + 1e-9, 6)
    missing = ratio(F.col("rows") - F.col("non_null"), F.col("rows"))
    return d.select(*keys, "rows", (F.col("rows") - F.col("non_null")).alias("nulls"), r6(missing).alias("missing_fraction"), r6(F.col("lo")).alias("minimum"), r6(F.col("hi")).alias("maximum"), r6(F.col("mean")).alias("mean"), *[r6(F.get("q", F.lit(i))).alias(n) for i, n in enumerate(("p05", "median", "p95"))])


def ks_distance(long: DataFrame, *keys: str) -> DataFrame:
    """Greatest distance of two cohorts' distribution functions; side is 'reference' or 'comparison'. Ties are one step."""
    v = long.where("x is not null").groupBy(*keys, "x").agg(F.count(F.when(F.col("side") == "reference", 1)).alias("a"), F.count(F.when(F.col("side") == "comparison", 1)).alias("b"))
    run, whole = Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    d = v.withColumns({"fa": ratio(F.sum("a").over(run), F.sum("a").over(whole)), "fb": ratio(F.sum("b").over(run), F.sum("b").over(whole))})
    g = d.groupBy(*keys).agg(F.round(F.max(F.abs(F.col("fa") - F.col("fb"))) + 1e-9, 6).alias("ks"))
    return g.withColumn("ks_status", F.when(F.col("ks").isNull(), "EMPTY_NON_NULL_COHORT").otherwise("AVAILABLE"))


def psi(long: DataFrame, bins: int = 10, alpha: float = 0.5, *keys: str) -> DataFrame:
    """Population stability over the reference's quantile bins, smoothed by alpha per bin; or why it is unavailable.

    Edges are distinct reference quantiles strictly inside its range; a value equal to an edge belongs to the bin above.
    """
    ref = long.where("side = 'reference' and x is not null")
    probs = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    edges = ref.groupBy(*keys).agg(F.percentile("x", probs).alias("e"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    edges = edges.withColumn("edges", F.array_sort(F.filter(F.array_distinct("e"), lambda t: (t > F.col("lo")) & (t < F.col("hi"))))).select(*keys, "lo", "hi", "edges")
    d = long.where("x is not null")
    d = d.join(F.broadcast(edges), list(keys)) if keys else d.crossJoin(F.broadcast(edges))  # a row for each feature
    counts = d.withColumn("bin", F.size(F.filter("edges", lambda t: t <= F.col("x")))).groupBy(*keys, "bin").agg(F.count(F.when(F.col("side") == "reference", 1)).alias("a"), F.count(F.when(F.col("side") == "comparison", 1)).alias("b"))
    grid = edges.select(*keys, "lo", "hi", F.size("edges").alias("m"), F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))
    full = grid.join(counts, [*keys, "bin"], "left").na.fill(0, ["a", "b"])
    whole = Window.partitionBy(*keys)
    k = F.col("m") + 1
    p = (F.col("a") + alpha) / (F.sum("a").over(whole) + alpha * k)
    q = (F.col("b") + alpha) / (F.sum("b").over(whole) + alpha * k)
    g = full.withColumns({"term": (q - p) * F.ln(q / p)}).groupBy(*keys).agg(F.sum("term").alias("s"), F.max(k).alias("k"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("b").alias("nb"))
    status = F.when(F.col("nb") == 0, "EMPTY_NON_NULL_COHORT").when(F.col("lo") == F.col("hi"), "DEGENERATE_REFERENCE").when(F.col("k") < 2, "INSUFFICIENT_EFFECTIVE_BINS").otherwise("AVAILABLE")
    return g.select(*keys, F.col("k").cast("long").alias("effective_bins"), status.alias("psi_status"), F.when(status == "AVAILABLE", F.round(F.col("s") + 1e-9, 6)).alias("psi"))


def categorical_shift(long: DataFrame, *keys: str) -> DataFrame:
    """Total variation and Jensen-Shannon (base 2) of two cohorts' categories; null is <MISSING>."""
    c = long.groupBy(*keys, F.coalesce("x", F.lit("<MISSING>")).alias("category")).agg(F.count(F.when(F.col("side") == "reference", 1)).alias("a"), F.count(F.when(F.col("side") == "comparison", 1)).alias("b"))
    whole = Window.partitionBy(*keys)
    d = c.withColumns({"p": ratio(F.col("a"), F.sum("a").over(whole)), "q": ratio(F.col("b"), F.sum("b").over(whole))}).withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / F.col("m"))).otherwise(0.0)
    return d.groupBy(*keys).agg(
        F.round(F.sum(F.abs(F.col("p") - F.col("q"))) / 2 + 1e-9, 6).alias("total_variation"),
        F.round(F.sum((part("p") + part("q")) / 2) + 1e-9, 6).alias("jensen_shannon"),
        F.count(F.when((F.col("a") == 0) & (F.col("b") > 0), 1)).alias("new_categories"),
        F.count(F.when((F.col("a") > 0) & (F.col("b") == 0), 1)).alias("disappeared_categories"),
    )


def category_changes(long: DataFrame, *keys: str) -> DataFrame:
    """Counts per category and whether it is NEW, DISAPPEARED or SHARED."""
    c = long.groupBy(*keys, F.coalesce("x", F.lit("<MISSING>")).alias("category")).agg(F.count(F.when(F.col("side") == "reference", 1)).alias("reference_count"), F.count(F.when(F.col("side") == "comparison", 1)).alias("comparison_count"))
    return c.withColumn("change", F.when(F.col("reference_count") == 0, "NEW").when(F.col("comparison_count") == 0, "DISAPPEARED").otherwise("SHARED"))


def support_gate(long: DataFrame, min_rows: int, min_non_null: int, *keys: str) -> DataFrame:
    ref, comp = F.col("side") == "reference", F.col("side") == "comparison"
    g = long.groupBy(*keys).agg(*[F.count(F.when(c, v)).alias(n) for n, c, v in (("ra", ref, F.lit(1)), ("rb", comp, F.lit(1)), ("na", ref, F.col("x")), ("nb", comp, F.col("x")))])
    why = F.when(F.least("ra", "rb") < min_rows, "INSUFFICIENT_ROWS").when(F.least("na", "nb") < min_non_null, "INSUFFICIENT_NON_NULL").otherwise("AVAILABLE")
    return g.select(*keys, F.col("ra").alias("reference_rows"), F.col("rb").alias("comparison_rows"), F.col("na").alias("reference_non_null"), F.col("nb").alias("comparison_non_null"), why.alias("support"))


def cohort_sides(df: DataFrame, us: str, ref: tuple[int, int], comp: tuple[int, int]) -> DataFrame:
    """Rows of two half-open windows, with their side."""
    if not (ref[0] < ref[1] <= comp[0] < comp[1]):
        raise ValueError("cohorts are ordered and disjoint")
    t = F.col(us)
    side = F.when((t >= ref[0]) & (t < ref[1]), "reference").when((t >= comp[0]) & (t < comp[1]), "comparison")
    return df.withColumn("side", side).where("side is not null")
