"""Domain views over the `events` table: transactions, their log, raw candidates, outcomes, feedback, predictions, commits.

Each view is a narrow projection (no shuffle), written twice: as a DataFrame here and as SQL in `SQL` for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-01-01T00:00:00Z in microseconds: where the event tables start.
EPOCH_US = 1704067200000000
HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def micros(col) -> F.Column:
    return F.unix_micros(col)


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx: one validated transaction per event."""
    e = read(spark, sf_dir, "events")
    t = F.col("ts").cast("timestamp")
    i, u = F.col("event_id"), F.col("user_id")
    return e.select(
        i,
        u.alias("customer_id"),
        t.alias("event_time"),
        F.timestamp_micros(F.unix_micros(t) + (2 + i % 11) * 1_000_000).alias("ingestion_time"),
        F.unix_micros(t).alias("event_us"),
        (F.unix_micros(t) + (2 + i % 11) * 1_000_000).alias("ingestion_us"),
        F.col("value").cast("decimal(18,4)").alias("amount"),
        F.when(i % 20 < 13, "USD").when(i % 20 < 17, "EUR").otherwise("GBP").alias("currency"),
        F.element_at(F.array(F.lit("US"), F.lit("GB"), F.lit("DE")), (u % 3 + 1).cast("int")).alias("country"),
        F.lit("CARD_PAYMENT").alias("transaction_type"),
        (u % 3).cast("int").alias("kafka_partition"),
        i.alias("kafka_offset"),
        F.least(F.lit(2), F.floor((F.unix_micros(t) - EPOCH_US) / (10 * DAY_US))).cast("int").alias("wave"),
    )


def transaction_log(tx: DataFrame) -> DataFrame:
    """tx_log: tx and a redelivery of every tenth event a minute later, at a later offset."""
    again = tx.where("event_id % 10 = 0").withColumns({"kafka_offset": F.col("kafka_offset") + 1_000_000_000, "transport_us": F.col("ingestion_us") + 60_000_000, "redelivered": F.lit(True)})
    return tx.withColumns({"transport_us": F.col("ingestion_us"), "redelivered": F.lit(False)}).unionByName(again)


RAW_FIELDS = ["event_id", "transaction_id", "customer_id", "merchant_id", "event_time", "ingestion_time", "amount", "currency", "country", "device_id", "ip_address", "transaction_type", "schema_version"]


def raw_candidates(tx: DataFrame) -> DataFrame:
    """tx_raw: untrusted string candidates; every fiftieth-class from 1 to 13 carries one kind of defect, 8 several."""
    k, i = F.col("event_id") % 50, F.col("event_id")

    def bad(values: dict[int, str | None], good) -> F.Column:
        out = None
        for n, v in values.items():
            out = F.when(k == n, F.lit(v).cast("string")) if out is None else out.when(k == n, F.lit(v).cast("string"))
        return good if out is None else out.otherwise(good)

    iso = lambda c: F.date_format(F.col(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return tx.select(
        i.alias("source_id"),
        bad({2: "not-a-uuid", 8: "nope"}, F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.lower(F.hex(i)), 12, "0"))).alias("event_id"),
        F.concat(F.lit("txn-"), i.cast("string")).alias("transaction_id"),
        bad({1: "  ", 8: ""}, F.concat(F.lit(" customer-"), F.col("customer_id").cast("string"))).alias("customer_id"),
        bad({12: None}, F.concat(F.lit("merchant-"), (i % 97).cast("string"))).alias("merchant_id"),
        bad({7: "yesterday"}, iso("event_time")).alias("event_time"),
        bad({13: "2024-13-01T00:00:00Z"}, iso("ingestion_time")).alias("ingestion_time"),
        bad({3: "-1.00", 8: "0", 9: "12.34567", 10: "123456789012345.1", 11: "abc", 14: "1.50000"}, F.col("amount").cast("string")).alias("amount"),
        bad({4: "usd", 8: "usd"}, F.col("currency")).alias("currency"),
        bad({8: "USA"}, F.col("country")).alias("country"),
        F.concat(F.lit("device-"), (i % 13).cast("string")).alias("device_id"),
        bad({8: "999.1.1.1"}, F.concat(F.lit("192.0.2."), (i % 256).cast("string"))).alias("ip_address"),
        bad({5: "WIRE_TRANSFER"}, F.lit("CARD_PAYMENT")).alias("transaction_type"),
        bad({6: "2", 15: "one"}, F.lit("1")).alias("schema_version"),
    )


def disordered(tx: DataFrame) -> DataFrame:
    """tx_disordered: every twentieth event is twelve hours late in event time."""
    shift = F.when(F.col("event_id") % 20 == 4, 12 * HOUR_US).otherwise(0)
    return tx.withColumns({"event_us": F.col("event_us") - shift, "event_time": F.timestamp_micros(F.col("event_us") - shift)})


def outcome(i: F.Column) -> F.Column:
    return F.when((i * 7919) % 1000 < 155, "FRAUD").otherwise("LEGIT")


def label_history(tx: DataFrame) -> DataFrame:
    """labels_rev: first outcomes with their delay, and corrections of every 33rd."""
    i = F.col("event_id")
    delay = F.when(i % 100 < 8, 720).when(i % 100 < 31, 72).otherwise(6) * HOUR_US
    first = tx.select("event_id", outcome(i).alias("outcome"), (F.col("ingestion_us") + delay).alias("observed_us"), F.lit("bank").alias("label_source"), F.lit(1).cast("long").alias("revision"))
    flip = F.when(F.col("outcome") == "FRAUD", "LEGIT").otherwise("FRAUD")
    second = first.where("event_id % 33 = 0").select("event_id", flip.alias("outcome"), (F.col("observed_us") + 96 * HOUR_US).alias("observed_us"), F.lit("review").alias("label_source"), F.lit(2).cast("long").alias("revision"))
    return first.unionByName(second)


def feedback(tx: DataFrame) -> DataFrame:
    """feedback: one case for every third event, of 1 to 3 revisions; those of every fifteenth arrive out of order."""
    i = F.col("event_id")
    d = tx.where("event_id % 3 = 0").select(
        F.when(i % 2 == 0, "provider-a").otherwise("provider-b").alias("provider_id"),
        F.concat(F.lit("case-"), i.cast("string")).alias("provider_case_id"),
        "event_id",
        "ingestion_us",
        F.explode(F.sequence(F.lit(1), (1 + i % 9 / 3).cast("int"))).alias("r"),
    )
    r, n = F.col("r"), (1 + i % 9 / 3).cast("int")
    status = F.when((r == 1) & (n > 1), "PENDING").when((r == 3) & (i % 21 == 0), "RETRACTED").otherwise(F.when(outcome(i) == "FRAUD", "CONFIRMED_FRAUD").otherwise("CONFIRMED_LEGIT"))
    back = F.when((i % 15 == 0) & (r == 2), 5).otherwise(0)
    return d.select(
        "provider_id",
        "provider_case_id",
        F.concat("provider_case_id", F.lit("-"), r.cast("string")).alias("provider_record_id"),
        "event_id",
        r.cast("long").alias("source_revision"),
        status.alias("status"),
        (F.col("ingestion_us") + (r * 2 + back) * DAY_US).alias("received_us"),
    )


def predictions(tx: DataFrame) -> DataFrame:
    return tx.select("event_id", "customer_id", "ingestion_us", "currency", "country", "transaction_type", "amount", (((F.col("event_id") * 2654435761) % 997).cast("double") / F.lit(997.0)).alias("p"))


def versions(tx: DataFrame, size: int = 500) -> DataFrame:
    """versions: each event and the table version whose commit brings it; odd versions are empty commits."""
    return tx.select("event_id", (2 * F.floor(F.col("event_id") / size)).cast("long").alias("version"), F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), F.col("amount").cast("string")), 256).alias("fingerprint"))


#: The same views as SQL (CTEs), for the oracle.
SQL = {
    "tx": f"""tx as (select event_id, user_id as customer_id, epoch_us(ts) as event_us, epoch_us(ts) + (2 + event_id % 11) * 1000000 as ingestion_us,
 cast(value as decimal(18,4)) as amount, case when event_id % 20 < 13 then 'USD' when event_id % 20 < 17 then 'EUR' else 'GBP' end as currency,
 case user_id % 3 when 0 then 'US' when 1 then 'GB' else 'DE' end as country, 'CARD_PAYMENT' as transaction_type,
 cast(user_id % 3 as integer) as kafka_partition, event_id as kafka_offset,
 cast(least(2, (epoch_us(ts) - {EPOCH_US}) // {10 * DAY_US}) as integer) as wave from events)""",
    "tx_log": """tx_log as (select *, ingestion_us as transport_us, false as redelivered from tx union all by name
 select * replace (kafka_offset + 1000000000 as kafka_offset), ingestion_us + 60000000 as transport_us, true as redelivered from tx where event_id % 10 = 0)""",
    "tx_raw": """tx_raw as (select event_id as source_id, case event_id % 50 when 2 then 'not-a-uuid' when 8 then 'nope' else '00000000-0000-4000-8000-' || lpad(lower(to_hex(event_id)), 12, '0') end as event_id,
 'txn-' || event_id as transaction_id, case event_id % 50 when 1 then '  ' when 8 then '' else ' customer-' || customer_id end as customer_id,
 case event_id % 50 when 12 then null else 'merchant-' || (event_id % 97) end as merchant_id,
 case event_id % 50 when 7 then 'yesterday' else strftime(make_timestamp(event_us), '%Y-%m-%dT%H:%M:%S.%fZ') end as event_time,
 case event_id % 50 when 13 then '2024-13-01T00:00:00Z' else strftime(make_timestamp(ingestion_us), '%Y-%m-%dT%H:%M:%S.%fZ') end as ingestion_time,
 case event_id % 50 when 3 then '-1.00' when 8 then '0' when 9 then '12.34567' when 10 then '123456789012345.1' when 11 then 'abc' when 14 then '1.50000' else cast(amount as varchar) end as amount,
 case when event_id % 50 in (4, 8) then 'usd' else currency end as currency, case event_id % 50 when 8 then 'USA' else country end as country,
 'device-' || (event_id % 13) as device_id, case event_id % 50 when 8 then '999.1.1.1' else '192.0.2.' || (event_id % 256) end as ip_address,
 case event_id % 50 when 5 then 'WIRE_TRANSFER' else 'CARD_PAYMENT' end as transaction_type, case event_id % 50 when 6 then '2' when 15 then 'one' else '1' end as schema_version from tx)""",
    "tx_disordered": f"""tx_disordered as (select * replace (case when event_id % 20 = 4 then event_us - {12 * HOUR_US} else event_us end as event_us) from tx)""",
    "labels_rev": f"""labels_1 as (select event_id, case when (event_id * 7919) % 1000 < 155 then 'FRAUD' else 'LEGIT' end as outcome,
 ingestion_us + case when event_id % 100 < 8 then 720 when event_id % 100 < 31 then 72 else 6 end * {HOUR_US} as observed_us, 'bank' as label_source, cast(1 as bigint) as revision from tx),
 labels_rev as (select * from labels_1 union all select event_id, case outcome when 'FRAUD' then 'LEGIT' else 'FRAUD' end, observed_us + 96 * {HOUR_US}, 'review', cast(2 as bigint) from labels_1 where event_id % 33 = 0)""",
    "feedback": f"""feedback_r as (select event_id, ingestion_us, 1 + (event_id % 9) // 3 as n, unnest(range(1, 2 + (event_id % 9) // 3)) as r from tx where event_id % 3 = 0),
 feedback as (select case when event_id % 2 = 0 then 'provider-a' else 'provider-b' end as provider_id, 'case-' || event_id as provider_case_id, 'case-' || event_id || '-' || r as provider_record_id,
 event_id, cast(r as bigint) as source_revision, case when r = 1 and n > 1 then 'PENDING' when r = 3 and event_id % 21 = 0 then 'RETRACTED' when (event_id * 7919) % 1000 < 155 then 'CONFIRMED_FRAUD' else 'CONFIRMED_LEGIT' end as status,
 ingestion_us + (r * 2 + case when event_id % 15 = 0 and r = 2 then 5 else 0 end) * {DAY_US} as received_us from feedback_r)""",
    "predictions": """predictions as (select event_id, customer_id, ingestion_us, currency, country, transaction_type, amount, cast((event_id * 2654435761) % 997 as double) / 997.0 as p from tx)""",
    "versions": """versions as (select event_id, 2 * (event_id // 500) as version, sha256(event_id || '|' || amount) as fingerprint from tx)""",
}


def with_views(*names: str) -> str:
    """'with a as (...), b as (...)' for the named views; tx comes first, as the others use it."""
    return "with recursive " + ",\n ".join(SQL[n] for n in dict.fromkeys(["tx", *names]))
