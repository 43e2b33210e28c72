"""URL filters: explicit rules first, then gradient-boosted trees on lexical features.

The URLs that a rule fits are the labelled ones. Statistics of host suffixes are taken over all of them (a table of
SUFFIX_BINS rows whatever the input); trees are fitted on at most `sample` of them, chosen by a hash of the URL, and judge
every URL that no rule fits. One model has the suffix statistics and judges URLs of suffixes that have labels; a fitted row
sees only the statistics of the other folds. Another one has none and judges the other suffixes. Each is tried on held-out
rows, the first on folds of URLs, the second on folds of whole suffixes, and blocks from the score (0.5 or more) at which
its precision there is `precision`; where it has none, nothing is blocked. The held-out precision and recall are returned.

Defined cases: a null URL or one without `://` has an empty host and path, fits no rule and is judged by the trees; with no
labelled URL of one kind every such URL is allowed; among rules that fit the longest wins, and of equally long ones the
smaller text; repeated rows are judged each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import LOWER, UPPER

SUFFIX_BINS = 4096
FOLDS = 5
FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digits", "digit_ratio", "entropy", "params", "hyphens", "has_fragment", "https", "suffix_rate", "suffix_seen"]
#: Features that do not come from labels.
LEXICAL = len(FEATURES) - 2


def split_url(url) -> tuple:
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting(near: Column, path: Column) -> Column:
    """The longest rule (rule, path, rule_verdict) of near that fits a path."""
    fits = F.filter(near, lambda x: F.startswith(path, x["path"]))
    return F.get(F.array_sort(F.transform(fits, lambda x: F.struct((-F.length(x["rule"])).alias("n"), x["rule"].alias("rule"), x["rule_verdict"].alias("rule_verdict")))), F.lit(0))


def match_rules(urls: DataFrame, rules: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """urls (with host and path) and the rule that fits, or null. rules: (allow or block, host/path).

    A list goes into the plan as a map from rule hosts to rules. A DataFrame of any length (verdict, rule) is joined with the
    suffixes of the distinct hosts, and these with the urls; rows of it that are no rules are an error.
    """
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    if isinstance(rules, DataFrame):
        verdict, rule = (F.col(c) for c in rules.columns[:2])
        checked = rules.select(F.when(verdict.isin("allow", "block") & (F.locate("/", rule) > 0), verdict).otherwise(F.raise_error(F.concat(F.lit("not a rule: "), F.coalesce(rule, F.lit("null"))))).alias("rule_verdict"), rule.alias("rule"))
        host = F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER)
        table = checked.select(host.alias("suffix"), F.struct("rule", F.expr("substring(rule, locate('/', rule))").alias("path"), "rule_verdict").alias("r"))
        hosts = urls.select("host").distinct().select("host", F.explode(suffixes).alias("suffix")).join(table, "suffix").groupBy("host").agg(F.collect_set("r").alias("__near"))
        found = urls.join(hosts, "host", "left").withColumn("__r", fitting(F.col("__near"), F.col("path"))).drop("__near")
        return found.withColumns({"rule": F.col("__r.rule"), "rule_verdict": F.col("__r.rule_verdict")}).drop("__r")
    hosts: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        if verdict not in ("allow", "block") or "/" not in rule:
            raise ValueError(f"not a rule: {verdict} {rule}")
        host, _, path = rule.partition("/")
        hosts.setdefault(host.translate(str.maketrans(UPPER, LOWER)), []).append((rule, "/" + path, verdict))
    entry = lambda r, p, v: F.struct(F.lit(r).alias("rule"), F.lit(p).alias("path"), F.lit(v).alias("rule_verdict"))
    table = F.create_map(*[x for h, rs in hosts.items() for x in (F.lit(h), F.array(*[entry(*r) for r in rs]))])
    none = F.filter(F.array(*[entry(*r) for rs in hosts.values() for r in rs]), lambda x: F.lit(False))
    near = F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(table, s), none)))
    return urls.withColumn("__r", fitting(near, F.col("path"))).withColumns({"rule": F.col("__r.rule"), "rule_verdict": F.col("__r.rule_verdict")}).drop("__r")


def suffix_bin(host: str) -> str:
    return ".".join(host.split(".")[-2:])


def features(url: str | None, host: str, path: str, rate: float, seen: float) -> list[float]:
    u = url or ""
    n = len(u)
    counts = Counter(u)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0
    digits = sum(c for ch, c in counts.items() if "0" <= ch <= "9")
    query = u.partition("?")[2].partition("#")[0]
    return [n, len(host), len(path), path.count("/"), host.count(".") + 1, digits, digits / n if n else 0.0, entropy, len([x for x in query.split("&") if x]), counts["-"], float("#" in u), float(u.startswith("https")), rate, math.log1p(seen)]


@dataclass(frozen=True)
class Boosting:
    trees: int = 40
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    l2: float = 1.0
    min_rows: int = 8


@dataclass
class Trees:
    """Complete binary trees: for each, features and cuts of the inner nodes and values of the leaves."""

    base: float
    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-out))


def fit_trees(x: np.ndarray, y: np.ndarray, p: Boosting = Boosting()) -> Trees:
    """Second-order boosting of the logistic loss over histogram bins."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, p.bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    margin = np.full(len(y), base)
    inner = 2**p.depth - 1
    fs, cs, vs = [], [], []
    for _ in range(p.trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        feat, cut, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        node = np.zeros(len(y), np.int64)
        for q in range(inner):
            here = np.flatnonzero(node == q)
            best, gain = None, 1e-6
            if len(here) >= 2 * p.min_rows:
                total_g, total_h = g[here].sum(), h[here].sum()
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[here, j]
                    gl = np.cumsum(np.bincount(b, g[here], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[here], len(e) + 1))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                    score = gl**2 / (hl + p.l2) + (total_g - gl) ** 2 / (total_h - hl + p.l2) - total_g**2 / (total_h + p.l2)
                    score[(nl < p.min_rows) | (len(here) - nl < p.min_rows)] = -1
                    if score.max() > gain:
                        gain, best = float(score.max()), (j, int(score.argmax()))
            if best:
                feat[q], cut[q] = best[0], edges[best[0]][best[1]]
            node[here] = 2 * q + 1 + (x[here, feat[q]] > cut[q])
        node -= inner
        for q in range(inner + 1):
            m = node == q
            leaf[q] = -p.rate * g[m].sum() / (h[m].sum() + p.l2)
        margin += leaf[node]
        fs, cs, vs = [*fs, feat], [*cs, cut], [*vs, leaf]
    return Trees(base, np.array(fs), np.array(cs), np.array(vs), p.depth)


@dataclass
class Judge:
    """Trees, the score from which they block, and their precision and recall there on rows they were not fitted on (null:
    they block nothing)."""

    trees: Trees | None = None
    least: float = math.inf
    precision: float | None = None
    recall: float | None = None


def held_out(x: np.ndarray, y: np.ndarray, fold: np.ndarray, boosting: Boosting, precision: float) -> Judge:
    """Trees of all rows, and the least score from 0.5 on that has the precision on held-out folds. x(fold): features with that fold left out."""
    score = np.full(len(y), -1.0)
    for f in np.unique(fold):
        out = fold == f
        if 0 < y[~out].sum() < (~out).sum():
            score[out] = fit_trees(x[~out], y[~out], boosting).score(x[out])
    order = np.argsort(-score, kind="stable")
    hits, ranks = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    last = np.append(score[order][1:] != score[order][:-1], True)  # a score's rows are blocked together
    good = np.flatnonzero(last & (score[order] >= 0.5) & (hits >= precision * ranks))
    trees = fit_trees(x, y, boosting)
    if not len(good):
        return Judge(trees)
    i = int(good[-1])
    return Judge(trees, float(score[order][i]), float(hits[i] / ranks[i]), float(hits[i] / y.sum()))


@dataclass
class Model:
    """seen: for suffixes with labels; other: for the rest. rates and counts: by suffix bin."""

    seen: Judge
    other: Judge
    rates: np.ndarray
    counts: np.ndarray


_VERDICT = "page_id long, host string, path string, rule string, verdict string, block_score double, held_precision double, held_recall double"


def _judge(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            n = batch.num_rows
            b = np.array(d["bin"], np.int64)
            known = model.counts[b] > 0
            score, least = np.zeros(n), np.full(n, math.inf)
            held: list[list] = [[None] * n, [None] * n]
            if n:
                x = np.array([features(u, h, p, model.rates[i], model.counts[i]) for u, h, p, i in zip(d["url"], d["host"], d["path"], b, strict=True)], float)
                for judge, rows, width in ((model.seen, known, len(FEATURES)), (model.other, ~known, LEXICAL)):
                    if judge.trees is not None and rows.any():
                        score[rows], least[rows] = judge.trees.score(x[rows][:, :width]), judge.least
                    for i in np.flatnonzero(rows).tolist():
                        held[0][i], held[1][i] = judge.precision, judge.recall
            verdict = [r or ("block" if s >= m else "allow") for r, s, m in zip(d["rule_verdict"], score, least, strict=True)]
            texts = [pa.array(d[c], pa.string()) for c in ("host", "path", "rule")]
            yield pa.RecordBatch.from_arrays([pa.array(d["page_id"], pa.int64()), *texts, pa.array(verdict, pa.string()), *(pa.array(c, pa.float64()) for c in (np.round(score, 6), *held))], names=[c.split()[0] for c in _VERDICT.split(", ")])

    return run


def labelled(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, host, path, bin (of the host's last two labels), rule, rule_verdict."""
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    host, path = split_url(F.col("url"))
    urls = urls.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    urls = match_rules(urls, rules)
    return urls.withColumn("bin", F.pmod(F.xxhash64(F.substring_index("host", ".", -2)), F.lit(SUFFIX_BINS)).cast("int"))


def fit(urls: DataFrame, sample: int = 20_000, boosting: Boosting = Boosting(), precision: float = 0.9) -> Model:
    """Judges (without trees where there are not both kinds) and block rates and counts by suffix bin, from labelled()'s rows."""
    fold = F.pmod(F.xxhash64("url", F.lit(3)), F.lit(FOLDS)).cast("int").alias("fold")
    known = urls.where("rule_verdict is not null").select("page_id", "url", "host", "path", "bin", (F.col("rule_verdict") == "block").cast("int").alias("y"), fold)
    n, y = np.zeros((FOLDS, SUFFIX_BINS)), np.zeros((FOLDS, SUFFIX_BINS))
    for r in known.groupBy("fold", "bin").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect():  # FOLDS * SUFFIX_BINS rows at most
        n[r.fold, r.bin], y[r.fold, r.bin] = r.n, r.y
    mean = y.sum() / max(1.0, n.sum())

    def rate(y: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (y + 20 * mean) / (n + 20)

    model = Model(Judge(), Judge(), rate(y.sum(0), n.sum(0)), n.sum(0))
    if not 0 < y.sum() < n.sum():
        return model
    # Half as many again as are wanted, by the same hash, so that no task sends the driver a sample of its own.
    share = min(1.0, 1.5 * sample / n.sum())
    near = known.where(F.shiftright(F.xxhash64("url", "page_id"), 33) < int((2 * share - 1) * 2**30))
    rows = near.orderBy(F.xxhash64("url", "page_id"), "page_id").limit(sample).collect()
    t, b, f = (np.array([r[c] for r in rows]) for c in ("y", "bin", "fold"))
    if not 0 < t.sum() < len(t):
        return model
    # A row's suffix statistics leave its own fold out, so its own label is not among its features.
    rates, counts = rate(y.sum(0) - y, n.sum(0) - n), n.sum(0) - n
    x = np.array([features(r.url, r.host, r.path, rates[r.fold, r.bin], counts[r.fold, r.bin]) for r in rows], float)
    suffix = np.unique(b, return_inverse=True)[1] % FOLDS
    return Model(held_out(x, t.astype(float), f, boosting, precision), held_out(x[:, :LEXICAL], t.astype(float), suffix, boosting, precision), model.rates, model.counts)


def url_filter(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url", sample: int = 20_000, boosting: Boosting = Boosting(), precision: float = 0.9) -> DataFrame:
    """page_id, host, path, rule (null if none), verdict, block_score, held_precision and held_recall (of the trees that judge
    such a URL; null: they block nothing) of every URL. Only the URL column is read."""
    ship(pages.sparkSession)
    urls = labelled(pages, rules, id_col, url_col)
    return urls.mapInArrow(_judge(fit(urls, sample, boosting, precision)), _VERDICT)
