"""Seeded synthetic transactions and scenario corpora, as expressions over spark.range: any size, no shuffle.

Draws are digests of (seed, row, purpose) by a small integer mixer that SQL engines share, so a corpus can be rebuilt
anywhere and checked by an independent engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START_US = 1893456000000000  # 2030-01-01T00:00:00Z


def draw(seed: int, purpose: int, modulo: int) -> Column:
    """A whole number below modulo for each row id."""
    x = (F.col("id") + F.lit(seed * 7919 + purpose * 104729)) * F.lit(2654435761) % F.lit(4294967291)
    x = (x * F.lit(48271) + F.col("id")) % F.lit(2147483647)
    return x % F.lit(modulo)


def _draw_sql(purpose: int, modulo: int) -> str:
    return f"((((id + {{seed}} * 7919 + {purpose} * 104729) * 2654435761 % 4294967291) * 48271 + id) % 2147483647 % {modulo})"


def transactions(spark: SparkSession, count: int, seed: int = 1, spacing_seconds: int = 30) -> DataFrame:
    """Valid string candidates, evenly spaced in time; currencies USD, EUR, GBP and documentation addresses."""
    pick = lambda p, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (draw(seed, p, len(xs)) + 1).cast("int"))
    us = F.lit(START_US) + F.col("id") * spacing_seconds * 1_000_000
    iso = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return spark.range(count).select(
        F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.lower(F.hex("id")), 12, "0")).alias("event_id"),
        F.format_string("txn-%08d", "id").alias("transaction_id"),
        F.format_string("customer-%04d", draw(seed, 1, 200)).alias("customer_id"),
        F.format_string("merchant-%03d", draw(seed, 2, 50)).alias("merchant_id"),
        iso(us).alias("event_time"),
        iso(us + 2_000_000).alias("ingestion_time"),
        (draw(seed, 3, 50_000) + 100).cast("decimal(18,4)").__truediv__(F.lit(100).cast("decimal(4,0)")).cast("decimal(18,4)").cast("string").alias("amount"),
        pick(4, "USD", "EUR", "GBP").alias("currency"),
        pick(5, "US", "DE", "GB").alias("country"),
        F.format_string("device-%03d", draw(seed, 6, 100)).alias("device_id"),
        F.concat(pick(7, "192.0.2.", "198.51.100.", "203.0.113."), draw(seed, 8, 256).cast("string")).alias("ip_address"),
        F.lit("CARD_PAYMENT").alias("transaction_type"),
        F.lit("1").alias("schema_version"),
    )


def scenario_corpus(spark: SparkSession, count: int, seed: int = 1) -> DataFrame:
    """Bursts of 5 in every 20 events, a late one at place 4, LARGE and CAMPAIGN profiles, three waves, delayed and
    corrected outcomes."""
    i = F.col("id")
    place = i % 20
    profile = F.when(draw(seed, 11, 100) < 4, "LARGE").when(draw(seed, 12, 100) < 6, "CAMPAIGN").otherwise("ORDINARY")
    base = (draw(seed, 13, 20_000) + 500).cast("decimal(18,4)")
    cents = F.when(profile == "LARGE", base * 10).otherwise(base)
    us = F.lit(START_US) + F.when(place < 5, F.floor(i / 20) * 20 * 60_000_000 + place * 5_000_000).otherwise(i * 60_000_000) - F.when(place == 4, 12_000_000).otherwise(0)
    rate = F.when(profile == "LARGE", 40).when(profile == "CAMPAIGN", 60).otherwise(5)
    fraud = draw(seed, 14, 100) < rate
    delay = F.when(draw(seed, 15, 100) < 8, 720).when(draw(seed, 15, 100) < 31, 72).otherwise(6)
    d = spark.range(count).select(
        i.alias("event_number"),
        F.format_string("customer-%04d", F.when(place < 5, F.floor(i / 20) % 40).otherwise(draw(seed, 16, 160))).alias("customer_id"),
        us.cast("long").alias("event_us"),
        (us + 2_000_000).cast("long").alias("ingestion_us"),
        (cents / F.lit(100).cast("decimal(4,0)")).cast("decimal(18,4)").alias("amount"),
        F.element_at(F.array(F.lit("USD"), F.lit("EUR"), F.lit("GBP")), (draw(seed, 17, 3) + 1).cast("int")).alias("currency"),
        profile.alias("latent_profile"),
        F.when(fraud, "FRAUD").otherwise("LEGIT").alias("initial_outcome"),
        (draw(seed, 18, 100) < 3).alias("corrected"),
        delay.cast("long").alias("delay_hours"),
        F.least(F.lit(2), F.floor(i * 3 / F.lit(count))).cast("int").alias("wave"),
    )
    flip = F.when(F.col("initial_outcome") == "FRAUD", "LEGIT").otherwise("FRAUD")
    return d.withColumn("outcome", F.when(F.col("corrected"), flip).otherwise(F.col("initial_outcome")))


def manifest(corpus: DataFrame) -> DataFrame:
    """Per wave: events, frauds, corrections, time range and mean label delay."""
    return corpus.groupBy("wave").agg(
        F.count("*").alias("events"),
        F.countDistinct("customer_id").alias("customers"),
        F.count(F.when(F.col("outcome") == "FRAUD", 1)).alias("frauds"),
        F.count(F.when(F.col("corrected"), 1)).alias("corrections"),
        F.min("event_us").alias("first_us"),
        F.max("event_us").alias("last_us"),
        F.sum("delay_hours").cast("long").alias("delay_hours"),
    )


_SQL = f"""with g as (select unnest(range(0, {{n}})) as id), c as (select id, id % 20 as place, case when {_draw_sql(11, 100)} < 4 then 'LARGE' when {_draw_sql(12, 100)} < 6 then 'CAMPAIGN' else 'ORDINARY' end as latent_profile,
 {_draw_sql(13, 20000)} + 500 as cents, {_draw_sql(14, 100)} as f, {_draw_sql(15, 100)} as y, {_draw_sql(16, 160)} as k, {_draw_sql(17, 3)} as q, {_draw_sql(18, 100)} as z from g),
 corpus as (select 'customer-' || lpad(cast(case when place < 5 then (id // 20) % 40 else k end as varchar), 4, '0') as customer_id,
 {START_US} + case when place < 5 then (id // 20) * 1200000000 + place * 5000000 else id * 60000000 end - case when place = 4 then 12000000 else 0 end as event_us,
 cast((case when latent_profile = 'LARGE' then cents * 10 else cents end) as decimal(18,4)) / 100 as amount, case q when 0 then 'USD' when 1 then 'EUR' else 'GBP' end as currency, latent_profile,
 (f < case latent_profile when 'LARGE' then 40 when 'CAMPAIGN' then 60 else 5 end) <> (z < 3) as fraud, z < 3 as corrected, case when y < 8 then 720 when y < 31 then 72 else 6 end as delay_hours, cast(least(2, id * 3 // {{n}}) as integer) as wave from c)"""
MANIFEST_SQL = _SQL + """ select wave, count(*) as events, count(distinct customer_id) as customers, count(case when fraud then 1 end) as frauds, count(case when corrected then 1 end) as corrections, min(event_us) as first_us, max(event_us) as last_us, cast(sum(delay_hours) as bigint) as delay_hours from corpus group by 1"""
PROFILES_SQL = _SQL + """ select wave, latent_profile, currency, count(*) as events, cast(sum(cast(amount as decimal(18,4))) as decimal(38,4)) as amount from corpus group by 1, 2, 3"""


def invalid_scenarios(spark: SparkSession) -> DataFrame:
    """Named bad candidates and the error each must give."""
    good = transactions(spark, 1).first().asDict()
    changes = [("blank_customer", "customer_id", "  ", "MissingRequiredField(customer_id)"), ("malformed_id", "event_id", "not-a-uuid", "MalformedEventId"), ("negative_amount", "amount", "-1.00", "NonPositiveAmount"), ("lower_currency", "currency", "usd", "InvalidCurrencyFormat"), ("wire_transfer", "transaction_type", "WIRE_TRANSFER", "UnsupportedTransactionType"), ("future_schema", "schema_version", "2", "UnsupportedSchemaVersion(2)"), ("bad_time", "event_time", "yesterday", "MalformedEventTime")]
    rows = [{**good, "scenario": name, field: value, "expected": error} for name, field, value, error in changes]
    return spark.createDataFrame([tuple(r[c] for c in ["scenario", "expected", *good]) for r in rows], ", ".join(f"{c} string" for c in ["scenario", "expected", *good]))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_tsv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Tab-separated rows whose header and number of fields must be those of ddl; a bad row fails the job."""
    return spark.read.schema(ddl).option("sep", "\t").option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
