"""Mixing sources to target weights with soft domain membership.

A softmax classifier over hashed words, fitted on at most `sample` labelled documents (chosen by a hash of their ids),
gives every document's domain posterior p. Rates r, one for each document, between 0 and max_rate, minimise
    1/2 * sum_k ((sum_d r_d t_d p_dk - b_k) / T)^2,
t being a document's words, T their sum and b the targets, by projected gradient in the metric of t. Steps are implicit (of
the residual after the step, so they may be large and small domains do not lag): Newton over K numbers finds that residual,
and a pass sums K totals, a Gram matrix and two sums for a proof of how far off the optimum is. Passes go on until the
residual is within a tolerance of the least one; one that cannot be brought to zero is logged. Tasks replay the short history
of residuals instead of storing rates. A document's copies are its rate rounded by a hash of its id, so the expectation is
exact.

Domains: good (quality 1, toxic 0), low (quality 0, toxic 0), toxic (toxic 1); labels with a null flag are ignored.

Defined cases: null and empty texts have no words, uniform features and rate 1 (they do not move any total); without labels
every posterior is uniform; ids labelled twice count twice; repeated rows get equal rates; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .kernels import TO_LOWER, slices, word_digests, word_spans

DOMAINS = ("good", "low", "toxic")
DIM_BITS = 15
#: Documents that a task of an iteration sums.
ROWS_A_TASK = 100_000


def domain_of(quality, toxic):
    return F.when(toxic == 1, 2).when((toxic == 0) & (quality == 1), 0).when((toxic == 0) & (quality == 0), 1)


def sparse(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """rows, words per text, and (text, feature, weight) triples: distinct hashed words, log counts, unit length."""
    for rows, data, off in slices(batch):
        low = TO_LOWER[data]
        st, en, woff = word_spans(low, off)
        feat = (word_digests(low, st, en) >> np.uint64(64 - DIM_BITS)).astype(np.int64)
        n = np.diff(woff)
        text = np.repeat(np.arange(len(n)), n)
        key, count = np.unique((text << DIM_BITS) | feat, return_counts=True)
        t, f = key >> DIM_BITS, key & ((1 << DIM_BITS) - 1)
        w = 1 + np.log(count)
        norm = np.sqrt(np.bincount(t, w * w, len(n)))
        yield rows, n, t, f, w / norm[t]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, n, t, f, w in sparse(batch):
            at = np.searchsorted(t, np.arange(len(n) + 1))
            part = batch.slice(rows.start, rows.stop - rows.start)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column(0),
                    "domain": part.column(2),
                    "f": pa.array([f[a:b].astype("<i4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                    "w": pa.array([w[a:b].astype("<f4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                }
            )


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_softmax(t: np.ndarray, f: np.ndarray, w: np.ndarray, y: np.ndarray, k: int, steps: int = 150, l2: float = 1e-5) -> np.ndarray:
    """Weights (features + 1, k) by full-batch Adam on class-balanced log loss."""
    dim = 1 << DIM_BITS
    used, f = np.unique(f, return_inverse=True)
    theta, m, v = (np.zeros((len(used) + 1, k)) for _ in range(3))
    count = np.maximum(1, np.bincount(y, minlength=k))
    weight = np.sqrt(len(y) / (k * count))[y][:, None] / len(y)
    one = np.eye(k)[y]
    for i in range(1, steps + 1):
        z = np.stack([np.bincount(t, w * theta[f, c], len(y)) for c in range(k)], 1) + theta[-1]
        e = (softmax(z) - one) * weight
        g = np.stack([np.append(np.bincount(f, w * e[t, c], len(used)), e[:, c].sum()) for c in range(k)], 1) + l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.2 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-9)
    out = np.zeros((dim + 1, k))
    out[used], out[-1] = theta[:-1], theta[-1]
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000) -> np.ndarray:
    """Classifier weights; zeros without labels. The sample is broadcast, so texts are not shuffled."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain_of(F.col("quality"), F.col("toxic")).alias("domain")).where("doc_id is not null and domain is not null")
    # Half as many again as are wanted, by the same hash, so that no task sends the driver a sample of its own.
    share = min(1.0, 1.5 * sample / max(1, known.count()))
    near = known.where(F.shiftright(F.xxhash64("doc_id"), 33) < int((2 * share - 1) * 2**30))
    chosen = near.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(sample)
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "domain").mapInArrow(_features, "doc_id long, domain int, f binary, w binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.domain, bytes(r.f)))
    if not rows:
        return np.zeros(((1 << DIM_BITS) + 1, len(DOMAINS)))
    f = [np.frombuffer(bytes(r.f), "<i4") for r in rows]
    t = np.repeat(np.arange(len(rows)), [len(x) for x in f])
    w = np.concatenate([np.frombuffer(bytes(r.w), "<f4") for r in rows]).astype(float)
    return fit_softmax(t, np.concatenate(f).astype(np.int64), w, np.array([r.domain for r in rows]), len(DOMAINS))


_P = [f"p_{d}" for d in DOMAINS]
_SCORES = "doc_id long, row long, n_tokens long, " + ", ".join(f"{p} double" for p in _P)


def _posteriors(theta: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ns, ps = [], [], []
            for rows, n, t, f, w in sparse(batch):
                z = np.stack([np.bincount(t, w * theta[f, c], len(n)) for c in range(theta.shape[1])], 1) + theta[-1]
                ids.append(rows)
                ns.append(n)
                ps.append(np.round(softmax(z), 9))
            if ids:
                p = np.concatenate(ps)
                yield pa.RecordBatch.from_arrays([*(pa.concat_arrays([batch.column(c).slice(r.start, r.stop - r.start) for r in ids]) for c in ("doc_id", "row")), pa.array(np.concatenate(ns), pa.int64()), *(pa.array(p[:, c]) for c in range(p.shape[1]))], names=["doc_id", "row", "n_tokens", *_P])

    return run


def rates_of(p: np.ndarray, history: np.ndarray, step: float, max_rate: float) -> np.ndarray:
    """Rates after the steps in history (iterations x domains of residuals), from rate 1."""
    r = np.ones(len(p))
    for e in history:
        r = np.clip(r - step * (p @ e), 0.0, max_rate)
    return r


def _totals(history: np.ndarray, step: float, trial: np.ndarray, max_rate: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums over documents, with rates a trial step after those of history: words of each domain, the Gram matrix of the
    documents that no bound holds, and the two sums of the step's and of the whole problem's dual."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(_P)
        sums = np.zeros(k + k * k + 2)
        for batch in batches:
            p = np.stack([batch.column(c + 1).to_numpy(zero_copy_only=False) for c in range(k)], 1)
            t = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            r0 = rates_of(p, history, 1.0, max_rate)
            slope = p @ trial
            to = r0 - step * slope
            r = np.clip(to, 0.0, max_rate)
            free = t * ((to >= 0) & (to <= max_rate))
            moved = (r - r0) ** 2 / (2 * step) if step else 0.0
            sums += np.concatenate([(t * r) @ p, ((p * free[:, None]).T @ p).ravel(), [(t * (slope * r + moved)).sum(), (t * np.minimum(0.0, max_rate * slope)).sum()]])
        yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["x"])

    return run


#: The first implicit step, in units of 1 / the Gram matrix's largest eigenvalue, its growth and where that ends.
FIRST_STEP, GROWTH, LARGEST_STEP = 100.0, 10.0, 1e6
#: Trial residuals of one step, a pass each; the next step goes on from the last.
TRIALS = 200
log = logging.getLogger(__name__)


def solve(scores: DataFrame, targets: dict[str, float], relative: bool, budget: float, max_rate: float, iterations: int = 300, tolerance: float = 1e-5, ws: Workspace | None = None) -> tuple[np.ndarray, float, list[list[float]]]:
    """History of scaled residuals, the step for rates_of, and the residual of every pass, the last one's at the end.

    Ends when the residual is within tolerance of zero or, where no rates meet the targets, of the least one (by the duality
    gap: |e - e*|^2 <= 2 gap). Raises if that takes more than so many implicit steps.
    """
    k = len(DOMAINS)
    history, trace = np.zeros((0, k)), []
    compact = scores.select("n_tokens", *_P)
    if ws is not None:  # the iterations read a table of fewer and larger files
        compact = ws.put(compact.coalesce(1 + scores.count() // ROWS_A_TASK), "compact")

    def sums(step: float, trial: np.ndarray) -> np.ndarray:
        out = compact.mapInArrow(_totals(history, step, trial, max_rate), "x array<double>")
        row = out.agg(*[F.sum(F.get("x", F.lit(c))).alias(f"x{c}") for c in range(k + k * k + 2)]).first()
        return np.array([x or 0.0 for x in row])

    x = sums(0.0, np.zeros(k))
    total = x[:k].sum()
    if not total:
        return history, 1.0, trace
    want = np.array([float(targets[d]) for d in DOMAINS])
    b = (want * x[:k] if relative else budget * total * want / want.sum()) / total
    largest = max(1e-9, float(np.linalg.eigvalsh(x[k : k + k * k].reshape(k, k)).max()) / total)
    step = FIRST_STEP / largest
    e = x[:k] / total - b
    trace.append([round(float(v), 9) for v in e])
    if np.abs(e).max() < tolerance:
        return history, 1.0, trace
    trial = np.zeros(k)
    for _ in range(iterations):
        # Newton on the step's dual, whose gradient is (residual at the trial's rates) - trial.
        ahead, last = np.zeros(k), None
        size = 1.0
        for _ in range(TRIALS):
            y = trial + size * ahead
            x = sums(step, y) / total
            e, value = x[:k] - b, x[-2] - y @ b - y @ y / 2
            trace.append([round(float(v), 9) for v in e])
            gap = e @ e / 2 - (x[-1] - y @ b - y @ y / 2)
            if np.abs(e).max() < tolerance or 2 * gap <= tolerance**2:
                if np.abs(e).max() >= tolerance:
                    log.warning("targets out of reach at these rates; least residual in shares of all words: %s", dict(zip(DOMAINS, trace[-1], strict=True)))
                return np.vstack([history, step * y]), 1.0, trace
            if last is not None and value < last + 1e-4 * size * (slope @ ahead) - 1e-15 and size > 1e-6:
                size /= 2
                continue
            slope = e - y
            if np.abs(slope).max() < 1e-14 or (last is not None and value - last < 1e-17 and np.abs(slope).max() < tolerance / 100):
                trial = y
                break
            ahead = np.linalg.solve(step * x[k : k + k * k].reshape(k, k) + np.eye(k), slope)
            trial, last, size = y, value, 1.0
        history = np.vstack([history, step * trial])
        step = min(step * GROWTH, LARGEST_STEP / largest)
    raise RuntimeError(f"rates not within {tolerance} of the best after {iterations} steps; residual {trace[-1]}")


def _rate(history: np.ndarray, step: float, max_rate: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _P], 1)
            n = batch.column("n_tokens").to_numpy(zero_copy_only=False)
            r = np.where(n > 0, rates_of(p, history, step, max_rate), 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(r, 9))], names=[*batch.schema.names, "rate"])

    return run


def mix_sources(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float],
    relative: bool = False,
    budget: float = 1.0,
    max_rate: float = 4.0,
    iterations: int = 300,
    sample: int = 3000,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
    ws: Workspace | None = None,
) -> DataFrame:
    """One row per document: doc_id, n_tokens (words), posteriors, rate, copies; row: with the number in row_col.

    targets: each domain's share of budget times all words; relative: its factor on the domain's own expected words.
    """
    if set(targets) != set(DOMAINS):
        raise ValueError(f"targets must name {DOMAINS}")
    ws = ws or Workspace(docs.sparkSession, "mixing")
    row = F.col(row_col) if row_col else F.lit(None)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.cast("long").alias("row"), F.col(text_col).alias("text"))
    theta = fit(d, labels, sample)
    scores = ws.put(d.mapInArrow(_posteriors(theta), _SCORES), "scores")
    history, step, _ = solve(scores, targets, relative, budget, max_rate, iterations, ws=ws)
    out = scores.mapInArrow(_rate(history, step, max_rate), _SCORES + ", rate double")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    out = out.withColumn("copies", F.floor(F.col("rate") + F.coalesce(draw, F.lit(0.0))).cast("long"))
    return out if row_col else out.drop("row")
