"""Baseline model: preprocessing, balanced logistic regression, scoring, candidate parity, runs and registry tables."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .monitoring import ratio

CATEGORIES = ["currency", "country", "transaction_type", "statistical_feature_status"]
NUMBERS = ["amount", "prior_transaction_count_5m", "prior_amount_sum_10m", "prior_amount_observation_count", "prior_amount_mean", "prior_amount_stddev", "amount_zscore"]


def prepared(features: DataFrame) -> DataFrame:
    """The model's columns only: categories as text, numbers as doubles with 0 for what is missing."""
    rest = [c for c in features.columns if c not in CATEGORIES + NUMBERS]
    return features.select(*rest, *[F.col(c).cast("string").alias(c) for c in CATEGORIES], *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in NUMBERS])


def weighted(train: DataFrame) -> DataFrame:
    """train with weight n / (2 * rows of its class); the two class counts are one small aggregate."""
    n = train.groupBy("fraud_label").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return train.join(F.broadcast(n.crossJoin(F.broadcast(total))), "fraud_label").withColumn("weight", ratio(F.col("total"), 2 * F.col("n"))).drop("n", "total")


def fit(train: DataFrame, max_iter: int = 1000) -> PipelineModel:
    """One-hot categories (unseen ones are all zeros), standardised numbers, L2 with C = 1; fitted on training rows only."""
    rows = prepared(train)
    n = rows.count()
    if n == 0 or rows.select("fraud_label").distinct().count() < 2:
        raise ValueError("training rows of both classes are needed")
    stages = [StringIndexer(inputCols=CATEGORIES, outputCols=[f"{c}_i" for c in CATEGORIES], handleInvalid="keep", stringOrderType="alphabetAsc"), OneHotEncoder(inputCols=[f"{c}_i" for c in CATEGORIES], outputCols=[f"{c}_v" for c in CATEGORIES], dropLast=True)]
    stages += [Imputer(inputCols=NUMBERS, outputCols=NUMBERS), VectorAssembler(inputCols=NUMBERS, outputCol="numbers"), StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True)]
    stages += [VectorAssembler(inputCols=[*[f"{c}_v" for c in CATEGORIES], "scaled"], outputCol="features"), LogisticRegression(labelCol="fraud_label", weightCol="weight", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, tol=1e-4, maxIter=max_iter)]
    return Pipeline(stages=stages).fit(weighted(rows))


def scored(model: PipelineModel, features: DataFrame, keep: list[str]) -> DataFrame:
    """keep and p, the estimated probability of fraud; out of range is an error."""
    p = vector_to_array("probability")[1]
    out = model.transform(prepared(features)).select(*keep, p.alias("p"))
    return out.withColumn("p", F.when((F.col("p") >= 0) & (F.col("p") <= 1), F.col("p")).otherwise(F.raise_error(F.lit("probability out of range")).cast("double")))


def ledger(model: PipelineModel, features: DataFrame, candidate: str, start_us: int, end_us: int, train_end_us: int) -> DataFrame:
    """Predictions of a fixed window after training, with a fingerprint of each source row."""
    if not train_end_us <= start_us < end_us:
        raise ValueError("the window starts at or after the end of training")
    t = F.col("ingestion_us")
    keep = ["event_id", "ingestion_us", "currency", "country", "transaction_type"]
    fp = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ["event_id", "ingestion_us", *CATEGORIES, *NUMBERS]]), 256)
    rows = features.where((t >= start_us) & (t < end_us)).withColumn("fingerprint", fp)
    return scored(model, rows, [*keep, "fingerprint"]).withColumn("candidate_id", F.lit(candidate))


def reload_parity(model: PipelineModel, path: str, features: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Save, load and score again: one row of compared rows and mismatches."""
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    a, b = scored(model, features, ["event_id"]), scored(again, features, ["event_id"]).withColumnRenamed("p", "q")
    return a.join(b, "event_id").agg(F.count("*").alias("compared"), F.count(F.when(F.abs(F.col("p") - F.col("q")) > tolerance, 1)).alias("mismatches"))


class Registry:
    """Runs and registered versions as append-only Parquet rows; a version, once written, is not changed."""

    DDL = "version string, candidate string, dataset string, split string, metric string, value double, registered_us long"

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def register(self, version: str, candidate: str, dataset: str, split: str, metrics: dict[str, float], registered_us: int) -> None:
        if self._exists() and self.rows().where(F.col("version") == version).limit(1).count():
            raise ValueError(f"{version} is registered already")
        rows = [(version, candidate, dataset, split, m, float(v), registered_us) for m, v in sorted(metrics.items())]
        self.spark.createDataFrame(rows, self.DDL).write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.DDL).parquet(self.path)

    def compare(self, left: str, right: str) -> DataFrame:
        """Change of every metric, with warnings where datasets or splits differ."""
        a, b = (self.rows().where(F.col("version") == v).alias(n) for v, n in ((left, "a"), (right, "b")))
        warn = F.concat_ws(",", F.when(F.col("a.dataset") != F.col("b.dataset"), "DATASET_DIFFERS"), F.when(F.col("a.split") != F.col("b.split"), "SPLIT_DIFFERS"))
        return a.join(b, F.col("a.metric") == F.col("b.metric"), "full_outer").select(F.coalesce("a.metric", "b.metric").alias("metric"), F.col("a.value").alias("left_value"), F.col("b.value").alias("right_value"), (F.col("b.value") - F.col("a.value")).alias("change"), warn.alias("warnings"))
