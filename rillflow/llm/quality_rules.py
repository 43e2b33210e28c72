"""Host-level quality rules. DataFrame operations only.

Each text is measured within its own row; failures of the soft rules are summed by host (`source`), each host's failure
rate is shrunk towards the corpus with a beta prior fitted to the hosts' rates by moments, and the host's verdict is joined
back. A host is bad when its shrunken rate is above the prior's mean by more than so many of the prior's standard
deviations, that is, by the measure of the hosts themselves. A document is rejected when it fails a base rule, or fails a
soft rule itself on a bad host; a document without failures is kept whatever its host.

Defined cases: a null text has no words (and so fails the base rule); a null host is one host of its own; repeated rows
are measured and counted each; an empty table gives an empty result; further columns are ignored. Repeats are found by
64-bit digests of three words within one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, words_of


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 10
    max_dup_line_percent: int = 30
    min_mean_chars: float = 2.0
    max_mean_chars: float = 12.0
    #: The prior's standard deviations above its mean from which a host is bad.
    host_excess: float = 0.5
    #: Host tables of at most this many rows are broadcast; larger ones are joined by shuffle, where skew is split.
    broadcast_hosts: int = 20_000


def sorted_windows(words: Column) -> Column:
    """The text's 3-word windows as (digest, place), sorted, so that repeated windows are neighbours."""
    n = F.size(words)
    return F.when(
        n >= 4,
        F.array_sort(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))),
    )


def measure(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns in keep, and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long)."""
    keep = docs.columns if keep is None else keep
    t = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(*keep, t.alias("__t"), words_of(F.col(text_col)).alias("__w"))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    d = d.select(*keep, "__w", sorted_windows(F.col("__w")).alias("__s"), F.regexp_count("__t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("__l"))
    s = F.col("__s")
    same = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
    places = F.array_sort(F.transform(same, lambda x: x["i"]))
    d = d.select(*keep, "__w", "n_symbols", F.size("__l").cast("long").alias("n_lines"), (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"), places.alias("__p"))
    p = F.col("__p")  # places of repeated windows, in order: each covers 3 words or as many as up to the next place
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return d.select(
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        F.char_length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def judge(measured: DataFrame, host_col: str = "source", rules: Rules = Rules()) -> DataFrame:
    """measured, with base_failed, soft_failures, host_rate, host_limit and kept."""
    n, r = F.col("n_words"), rules
    base = (n < r.min_words) | (100 * F.col("n_repeat_words") > r.max_repeat_percent * n)
    soft = (
        (100 * F.col("n_symbols") > r.max_symbol_percent * n).cast("int")
        + (100 * F.col("n_dup_lines") > r.max_dup_line_percent * F.col("n_lines")).cast("int")
        + ((F.col("word_chars") < r.min_mean_chars * n) | (F.col("word_chars") > r.max_mean_chars * n)).cast("int")
    )
    d = measured.withColumns({"base_failed": base, "soft_failures": F.when(n > 0, soft).otherwise(0), "__host": F.coalesce(F.col(host_col).cast("string"), F.lit("\x00"))})
    failed = (F.col("base_failed") | (F.col("soft_failures") > 0)).cast("long")
    hosts = d.groupBy("__host").agg(F.count("*").alias("__n"), F.sum(failed).alias("__f"))
    rate = F.col("__f") / F.col("__n")
    # Moments over hosts, weighted by their documents, give the prior's mean and strength.
    prior = hosts.agg((F.sum("__f") / F.sum("__n")).alias("__mu"), (F.sum(F.col("__n") * rate * rate) / F.sum("__n")).alias("__m2"))
    var = F.greatest(F.col("__m2") - F.col("__mu") * F.col("__mu"), F.lit(1e-9))
    strength = F.greatest(F.lit(1.0), F.least(F.lit(1e6), F.col("__mu") * (1 - F.col("__mu")) / var - 1))
    prior = prior.select("__mu", strength.alias("__k"))
    limit = F.col("__mu") + r.host_excess * F.sqrt(F.col("__mu") * (1 - F.col("__mu")) / (F.col("__k") + 1))
    shrunken = (F.col("__f") + F.col("__k") * F.col("__mu")) / (F.col("__n") + F.col("__k"))
    verdicts = hosts.crossJoin(F.broadcast(prior)).select("__host", shrunken.alias("host_rate"), limit.alias("host_limit"))
    if hosts.limit(rules.broadcast_hosts + 1).count() <= rules.broadcast_hosts:
        verdicts = F.broadcast(verdicts)
    d = d.join(verdicts, "__host")
    return d.withColumn("kept", ~F.col("base_failed") & ~((F.col("soft_failures") > 0) & (F.col("host_rate") > F.col("host_limit")))).drop("__host")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", rules: Rules = Rules(), ws: Workspace | None = None) -> DataFrame:
    """One row per document: id, host, measures, base_failed, soft_failures, host_rate, host_limit, kept. Texts are read once."""
    ws = ws or Workspace(docs.sparkSession, "quality")
    keep = [id_col] + ([host_col] if host_col != id_col else [])
    return judge(ws.put(measure(docs.select(*dict.fromkeys([*keep, text_col])), text_col, keep), "measures"), host_col, rules)
