"""Candidate validation as column expressions: every error of a row, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.events import RAW_FIELDS

_UUID = "^[0-9a-fA-F]{1,8}-[0-9a-fA-F]{1,4}-[0-9a-fA-F]{1,4}-[0-9a-fA-F]{1,4}-[0-9a-fA-F]{1,12}$"
_INSTANT = "^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d{1,9})?Z$"
_NUMBER = "^[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?$"
_OCTET = "(0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]))"
_IPV4 = f"^{_OCTET}\\.{_OCTET}\\.{_OCTET}\\.{_OCTET}$"
TRANSACTION_TYPES = ("CARD_PAYMENT",)
SCHEMA_VERSION = 1


def present(name: str) -> Column:
    return F.nullif(F.trim(F.col(name)), F.lit(""))


def _amount_error(v: Column) -> Column:
    n = F.expr("try_cast(nullif(trim(amount), '') as decimal(38,18))")
    digits = F.regexp_replace(F.regexp_extract(v, "^[+-]?0*(\\d*)", 1), "^0+", "")
    fraction = F.regexp_replace(F.regexp_extract(v, "\\.(\\d*)", 1), "0+$", "")
    return (
        F.when(~v.rlike(_NUMBER), "MalformedAmount")
        .when(n.isNull() & (F.length(digits) > 14), "AmountPrecisionExceeded")
        .when(n.isNull(), "MalformedAmount")
        .when(n <= 0, "NonPositiveAmount")
        .when(F.length(fraction) > 4, "AmountScaleExceeded")
        .when(F.length(digits) > 14, "AmountPrecisionExceeded")
    )


def errors() -> Column:
    """array<string> of all errors: missing fields in field order, then malformed ones."""
    v = {n: present(n) for n in RAW_FIELDS}
    instant = lambda c: ~c.rlike(_INSTANT) | F.try_to_timestamp(F.regexp_replace(c, "(\\.\\d{6})\\d+", "$1")).isNull()
    version = F.expr("try_cast(nullif(trim(schema_version), '') as int)")
    parts = [F.when(v[n].isNull(), f"MissingRequiredField({n})") for n in RAW_FIELDS]
    parts += [
        F.when(v["event_id"].isNotNull() & ~v["event_id"].rlike(_UUID), "MalformedEventId"),
        F.when(v["event_time"].isNotNull() & instant(v["event_time"]), "MalformedEventTime"),
        F.when(v["ingestion_time"].isNotNull() & instant(v["ingestion_time"]), "MalformedIngestionTime"),
        F.when(v["amount"].isNotNull(), _amount_error(v["amount"])),
        F.when(v["transaction_type"].isNotNull() & ~v["transaction_type"].isin(*TRANSACTION_TYPES), "UnsupportedTransactionType"),
        F.when(v["schema_version"].isNotNull(), F.when(version.isNull(), "MalformedSchemaVersion").when(version != SCHEMA_VERSION, F.concat(F.lit("UnsupportedSchemaVersion("), version.cast("string"), F.lit(")")))),
        F.when(v["currency"].isNotNull() & ~v["currency"].rlike("^[A-Z]{3}$"), "InvalidCurrencyFormat"),
        F.when(v["country"].isNotNull() & ~v["country"].rlike("^[A-Z]{2}$"), "InvalidCountryFormat"),
        F.when(v["ip_address"].isNotNull() & ~v["ip_address"].rlike(_IPV4), "InvalidIpAddressFormat"),
    ]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def validate(raw: DataFrame) -> DataFrame:
    return raw.withColumn("errors", errors())


def accepted(validated: DataFrame, mode: str = "quarantine") -> DataFrame:
    """Typed columns of rows without errors. mode 'fail': one bad row fails the job; 'quarantine': bad rows are left out."""
    if mode not in ("fail", "quarantine"):
        raise ValueError("mode is fail or quarantine")
    if mode == "fail":
        ok = F.when(F.size("errors") == 0, True).otherwise(F.raise_error(F.concat_ws(",", "errors")).cast("boolean"))
        validated = validated.where(ok)
    else:
        validated = validated.where(F.size("errors") == 0)
    # try_cast keeps the projection total: Catalyst may evaluate it before the filter on rows with errors.
    typed = {"event_time": F.try_to_timestamp(present("event_time")), "ingestion_time": F.try_to_timestamp(present("ingestion_time")), "amount": F.expr("try_cast(trim(amount) as decimal(18,4))"), "schema_version": F.expr("try_cast(trim(schema_version) as int)"), "event_id": F.lower(present("event_id"))}
    return validated.select(*[c for c in validated.columns if c not in RAW_FIELDS and c != "errors"], *[typed.get(n, present(n)).alias(n) for n in RAW_FIELDS])


def statistical_errors(count: str = "prior_amount_observation_count", mean: str = "prior_amount_mean", sd: str = "prior_amount_stddev", z: str = "amount_zscore", status: str = "statistical_feature_status", floor: float = 1e-12) -> Column:
    """True where a row's status does not agree with its count, moments and score."""
    n, m, s, zz, st = (F.col(c) for c in (count, mean, sd, z, status))
    ok = (
        F.when(st == "NO_HISTORY", (n == 0) & m.isNull() & s.isNull() & zz.isNull())
        .when(st == "INSUFFICIENT_VARIANCE_HISTORY", (n == 1) & m.isNotNull() & s.isNull() & zz.isNull())
        .when(st == "ZERO_VARIANCE", (n >= 2) & m.isNotNull() & (s >= 0) & (s <= floor) & zz.isNull())
        .when(st == "READY", (n >= 2) & m.isNotNull() & (s > floor) & zz.isNotNull())
        .otherwise(False)
    )
    return ~F.coalesce(ok, F.lit(False))
