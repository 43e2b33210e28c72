"""NumPy kernels over the UTF-8 bytes of Arrow string columns: words, shingles, rolling digests, minimisers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Texts are taken in slices of about this many bytes, so memory does not follow the Arrow batch; one text is never cut.
SLICE = 1 << 20
_BASE = U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32
_POW: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    key = "i" if inverse else "p"
    if key not in _POW or len(_POW[key]) < n:
        x = np.full(max(n, SLICE * 2), _BASE_INV if inverse else _BASE, U)
        x[0] = 1
        _POW[key] = np.multiply.accumulate(x)
    return _POW[key][:n]


def slices(batch: pa.RecordBatch, col: str = "text", size: int = SLICE):
    """(rows, bytes, offsets) for consecutive rows; null texts are empty."""
    text = batch.column(batch.schema.get_field_index(col)).cast(pa.large_string()).fill_null("")
    off = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1 + text.offset)[text.offset :]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None and off[-1] else np.zeros(0, np.uint8)
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield slice(i, j), data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the number of words before it (one more entry at the end)."""
    w = IS_WORD[data]
    prev, after = np.zeros(len(w), bool), np.zeros(len(w), bool)
    prev[1:], after[:-1] = w[:-1], w[1:]
    cut = off[(off > 0) & (off < len(w))]
    prev[cut], after[cut - 1] = False, False
    st, en = np.flatnonzero(w & ~prev), np.flatnonzero(w & ~after) + 1
    return st, en, np.searchsorted(st, off)


def prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def span_digest(cs: np.ndarray, st: np.ndarray, en: np.ndarray) -> np.ndarray:
    """64-bit digests of spans, from prefix(); equal spans have equal digests wherever they start."""
    return mix((cs[en] - cs[st]) * powers(len(cs), True)[st] + (en - st).astype(U) * U(0xA24BAED4963EE407))


def word_digests(data: np.ndarray, st: np.ndarray, en: np.ndarray) -> np.ndarray:
    return span_digest(prefix(BYTE[data]), st, en)


def grams(digests: np.ndarray, k: int) -> np.ndarray:
    """Digest of the k values from each position on."""
    n = max(0, len(digests) - k + 1)
    return span_digest(prefix(digests), np.arange(n), np.arange(k, k + n))


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles of each text (one after the other) and their offsets; with fewer words, one of all."""
    st, en, woff = word_spans(TO_LOWER[data], off)
    d = word_digests(TO_LOWER[data], st, en)
    g = grams(d, k)
    out = []
    for i, j in zip(woff[:-1].tolist(), woff[1:].tolist(), strict=True):
        if j - i >= k:
            out.append(np.unique(g[i : j - k + 1]))
        elif j > i:
            out.append(span_digest(prefix(d[i:j]), np.array([0]), np.array([j - i])))
        else:
            out.append(d[:0])
    return (np.concatenate(out) if out else d[:0]), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of the w values from each position on."""
    size, cur = 1, x
    while size * 2 <= w:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    return np.minimum(cur[: len(cur) - (w - size)], cur[w - size :]) if w > size else cur


_SEG, _POS = 1 << 22, U((1 << 24) - 1)


def minimiser_runs(values: np.ndarray, off: np.ndarray, k: int, m: int) -> tuple[np.ndarray, ...]:
    """Maximal runs of k-windows (inside one text) that share the occurrence of their minimiser, an m-gram.

    values: a digest for each symbol; off: where texts start. Returns text number, start in the text, number of windows,
    the minimiser's digest, a digest of the run's symbols, and the minimiser's place in the run, for each run. The order of
    m-grams is that of their digests' upper 40 bits, ties go to the left, so equal windows choose equal places.
    """
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),) * 2 + (np.zeros(0, np.int64),)
    if len(values) < k:
        return none
    cs = prefix(values)
    n, w = len(values), k - m + 1
    g = mix((cs[m:] - cs[: n - m + 1]) * powers(n + 1, True)[: n - m + 1] + U(m * 0xA24BAED4963EE407 % (1 << 64)))
    at = np.empty(n - k + 1, np.int64)
    for s in range(0, n - k + 1, _SEG):
        e = min(n - k + 1, s + _SEG)
        part = g[s : e + w - 1]
        at[s:e] = s + (sliding_min((part & ~_POS) | np.arange(len(part), dtype=U), w) & _POS).astype(np.int64)
    lens = np.diff(off)
    nwin = np.maximum(0, lens - k + 1)
    # Where the place changes, and where texts begin; not the windows that reach from one text into the next.
    new = np.union1d(np.flatnonzero(at[1:] != at[:-1]) + 1, off[:-1][nwin > 0])
    text = np.searchsorted(off, new, "right") - 1
    own = new < off[text] + nwin[text]
    new, text = new[own], text[own]
    if not len(new):
        return none
    end = np.minimum(off[text] + nwin[text], np.append(new[1:], n))
    return text, new - off[text], end - new, g[at[new]], span_digest(cs, new, end + k - 1), at[new] - new
