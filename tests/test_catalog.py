"""Every registered query against its SQL on a generated events table, and the entry's guard."""

import math
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from rillflow import catalog, schemas

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Events, orders, customers and lines of the driver's shape, smaller."""
    d = tmp_path_factory.mktemp("sf")
    ts = F.timestamp_micros(F.lit(1704067200000000) + F.col("id") * 2_160_000_000 + F.col("id") % 7 * 1_000_003).cast("timestamp_ntz")
    spark.range(1200).select(F.col("id").alias("event_id"), ts.alias("ts"), (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(30)) + 1).alias("user_id"), F.lit("click").alias("event_type"), (F.pmod(F.xxhash64("id"), F.lit(48900)) / 100 + 1).alias("value"), F.lit("{}").alias("props")).coalesce(1).write.parquet(f"{d}/e")
    spark.range(600).select(F.col("id").alias("o_orderkey"), (F.col("id") % 25).alias("o_custkey"), (F.col("id") * 91 % 5000 / 7).alias("o_totalprice"), F.timestamp_micros(F.lit(694224000000000) + F.col("id") * 7 % 300 * 86_400_000_000).cast("timestamp_ntz").alias("o_orderdate")).coalesce(1).write.parquet(f"{d}/o")
    spark.range(25).select(F.col("id").alias("c_custkey"), F.concat(F.lit("seg"), (F.col("id") % 3).cast("string")).alias("c_mktsegment")).coalesce(1).write.parquet(f"{d}/c")
    spark.range(900).select((F.col("id") % 600).alias("l_orderkey"), (F.col("id") * 13 % 997 / 4).alias("l_extendedprice"), F.lit("A").alias("l_returnflag")).coalesce(1).write.parquet(f"{d}/l")
    for short, name in (("e", "events"), ("o", "orders"), ("c", "customer"), ("l", "lineitem")):
        next(Path(f"{d}/{short}").glob("part-*.parquet")).rename(f"{d}/{name}.parquet")
    return str(d)


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return str(round(x, 8)) if isinstance(x, float) else str(x.normalize()) if isinstance(x, Decimal) else str(x)


SLOW = {"dedup_stream", "rolling_stream", "stat_stream", "activity_stream", "risk_stream", "baseline_scores", "baseline_metrics", "prediction_ledger"}


@pytest.mark.parametrize("name", [n for n in catalog.oracle_sql() if n not in SLOW])
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("events", "orders", "customer", "lineitem"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = catalog.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    con.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in con.description]
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in con.fetchall()]
    assert sorted(names) == cols
    assert sorted(got, key=str) == sorted(want, key=str)


def test_consistency_takes_keys_without_variance(spark, tmp_path):
    """One customer pays the same three times, then another amount: the last two rows have a deviation of exactly zero."""
    rows = [(20 * i, 1704067200000000 + i * 60_000_000, v) for i, v in enumerate((7.5, 7.5, 7.5, 9.0))]
    d = spark.createDataFrame(rows, "event_id long, us long, value double")
    d.select("event_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"), "value").coalesce(1).write.parquet(f"{tmp_path}/e")
    next(tmp_path.glob("e/part-*.parquet")).rename(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    status = {r.event_id: r.statistical_feature_status for r in catalog.queries()["stat_prior_moments"](spark, str(tmp_path)).collect()}
    assert status == {0: "NO_HISTORY", 20: "INSUFFICIENT_VARIANCE_HISTORY", 40: "ZERO_VARIANCE", 60: "ZERO_VARIANCE"}
    got = [tuple(r) for r in catalog.queries()["statistical_consistency"](spark, str(tmp_path)).collect()]
    assert got == con.execute(catalog.oracle_sql()["statistical_consistency"]).fetchall() == [(4, 0, 0, 0)]


def test_flagship_has_the_decision_schema(spark, sf_dir):
    df = catalog.flagship(spark, sf_dir)
    schemas.check(df, schemas.RISK)
    assert df.count() > 0


def test_entry_imports_without_the_llm_parts(tmp_path):
    """The registry works when the subpackage and the pipeline are deleted, and other import errors are not hidden."""
    for p in ("rillflow", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "rillflow/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
