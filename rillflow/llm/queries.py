"""The registered queries: each operator with production parameters over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(_read(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    out = exact_dedup(_read(spark, sf_dir, "documents"), keep="largest")
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    out = quality_rules(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(_read(spark, sf_dir, "documents"), k=50)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import format_conversations, read_back

    turns = _read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return read_back(format_conversations(turns.unionByName(extra)))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack
    from .tokens import Tokenizer

    return pack(_read(spark, sf_dir, "documents"), Tokenizer(str(public_tokenizers.path("byte_bpe_50k.json")), added=True), length=1024)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    return license_scan(_read(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(_read(spark, sf_dir, "documents"), k=200)


#: Production targets: shares of all words.
MIX = {"good": 0.9, "low": 0.08, "toxic": 0.02}


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_mixing import mix_sources

    return mix_sources(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), MIX)


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import url_filter

    return url_filter(_read(spark, sf_dir, "pages"), RULES)


def queries() -> dict:
    own = [op1_ngram_jaccard_join, op2_exact_dedup, op3_quality_rules, op4_substring_dedup, op5_chat_formatting, op6_packing, op7_license_scan, op8_suffix_array_dedup, op9_source_mixing, op10_url_filter]
    return {f.__name__: f for f in own}


_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

_OP2 = """
with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as h from documents),
g as (select h, max(doc_id) as keep_id, count(*) as group_size from d group by h)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, h as text_sha256 from d join g using (h)
"""

_OP3_MEASURES = f"""
t as (select doc_id, coalesce(source, chr(0)) as host, coalesce(text, '') as text, {_WORDS} as w from documents),
win as (select doc_id, i, w[i] || chr(31) || w[i + 1] || chr(31) || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from t)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) where c > 1),
cov as (select doc_id, count(distinct i + j) as n_repeat_words from rep, (values (0), (1), (2)) as o(j) group by doc_id),
m as (select doc_id, host, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines,
  coalesce(n_repeat_words, 0)::bigint as n_repeat_words from t left join cov using (doc_id)),
b as (select doc_id, host, n_words, word_chars, n_symbols, len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m),
s as (select *, case when n_words = 0 then 0 else (100 * n_symbols > 10 * n_words)::int + (100 * n_dup_lines > 30 * n_lines)::int
  + (word_chars < 2 * n_words or word_chars > 12 * n_words)::int end as soft from b),
h as (select host, count(*)::double as n, sum((base_failed or soft > 0)::int)::double as f from s group by host),
p as (select sum(f) / sum(n) as mu, sum(n * (f / n) * (f / n)) / sum(n) as m2 from h),
k as (select mu, greatest(1.0, least(1e6, mu * (1 - mu) / greatest(m2 - mu * mu, 1e-9) - 1)) as strength from p),
v as (select host, (f + strength * mu) / (n + strength) as rate, mu + 0.5 * sqrt(mu * (1 - mu) / (strength + 1)) as host_limit from h, k)
"""

_OP3 = f"""
with {_OP3_MEASURES}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not (soft > 0 and rate > host_limit) as kept
from s join v using (host)
"""


_OP1 = f"""
with recursive t as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g from t),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 90 * (x.n + y.n - o)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as node, doc_id as other from documents union select r.node, e.b from r join e on e.a = r.other)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id from documents d left join n using (doc_id) join (select node as doc_id, min(other) as component_id from r group by 1) c using (doc_id)
"""

_OP4 = f"""
with t as (select doc_id, {_WORDS} as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 49], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from t)),
f as (select g, min(doc_id) as first from win group by 1),
cov as (select distinct doc_id, unnest(range(i, i + 50)) as i from win join f using (g) where first < doc_id),
x as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from t),
k as (select x.doc_id, string_agg(word, ' ' order by x.i) as kept from x anti join cov on cov.doc_id = x.doc_id and cov.i = x.i group by 1),
c as (select doc_id, count(*) as n_removed from cov group by 1)
select t.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from t left join c using (doc_id) left join k using (doc_id)
"""

_OP5 = """
with a as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
b as (select *, length(regexp_replace(text, '(\\\\|<s>|</s>|\\[/?INST\\]|\\[/?ROLE\\]|<\\|(?:image|audio|document):[0-9]+\\|>)', '!\\1', 'g')) as n from a)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256, coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256, sum(n + case role when 'user' then 18 when 'assistant' then 6 else 24 + length(role) end)::bigint as formatted_chars, 0::bigint as attachment_tokens from b group by 1
"""


#: In hexadecimal, two characters a byte; windows are compared by 128-bit digests.
_OP8 = """
with t as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
win as (select doc_id, i, md5_number(h[2 * i + 1:2 * i + 400]) as g from (select doc_id, h, unnest(range(0, len(h) // 2 - 199)) as i from t)),
cov as (select doc_id, i from (select doc_id, i, count(*) over (partition by g) as c from win) where c > 1),
st as (select doc_id, i, coalesce(i - lag(i) over (partition by doc_id order by i) > 200, true) as new, least(200, coalesce(lead(i) over (partition by doc_id order by i) - i, 200)) as n from cov),
sp as (select doc_id, i, n, sum(new::int) over (partition by doc_id order by i) as s from st),
span as (select doc_id, min(i) as a, max(i) + 200 as b from sp group by doc_id, s),
gap as (select doc_id, b as lo, coalesce(lead(a) over (partition by doc_id order by a), 1000000000000) as hi from span union all select doc_id, 0, min(a) from span group by doc_id),
k as (select doc_id, string_agg(h[2 * lo + 1:least(2 * hi, len(h))], '' order by lo) as kept from gap join t using (doc_id) group by doc_id),
r as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans from span group by doc_id)
select t.doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from t left join r using (doc_id) left join k using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": _OP1, "op2_exact_dedup": _OP2, "op3_quality_rules": _OP3, "op4_substring_dedup": _OP4, "op5_chat_formatting": _OP5, "op8_suffix_array_dedup": _OP8}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: What is left of the documents after the pipeline's quality rules, after its exact dedup and after its near-copy stage.
_QUALITY = f"""with recursive {_OP3_MEASURES.strip()},
q as (select documents.* from documents join (select doc_id from s join v using (host) where not base_failed and not (soft > 0 and rate > host_limit)) using (doc_id))"""
_EXACT = f"""{_QUALITY}, e as (select * from q where doc_id in (select min(doc_id) from q group by {_LOWER}))"""
_NEAR = f"""{_EXACT},
nw as (select doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from e),
ns as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from nw),
nn as (select doc_id, count(*) as n from ns group by 1),
np as (select a.doc_id as a, b.doc_id as b, count(*) as o from ns a join ns b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
nl as (select a, b from np join nn x on x.doc_id = a join nn y on y.doc_id = b where 100 * o >= 80 * (x.n + y.n - o)),
ne as (select a, b from nl union all select b, a from nl),
nr as (select doc_id as node, doc_id as other from e union select nr.node, ne.b from nr join ne on ne.a = nr.other),
near as (select * from e where doc_id in (select node from nr group by node having min(other) = node))"""
STAGE_SQL = [f"{_QUALITY} select * from q", f"{_EXACT} select * from e", f"{_NEAR} select * from near"]
