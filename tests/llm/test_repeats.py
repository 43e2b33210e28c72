import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from rillflow.llm import repeats
from rillflow.llm import suffix_dedup as suffix_dedup_module
from rillflow.llm.kernels import minimiser_runs, mix
from rillflow.llm.substring_dedup import substring_dedup
from rillflow.llm.suffix_dedup import collection, range_minima, repeated, suffix_dedup


def passages(seed, n, sep=" ", vocab=300):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(vocab)}"
    shared = [[word() for _ in range(r.randrange(8, 40))] for _ in range(5)]
    out = []
    for _ in range(n):
        w = []
        for _ in range(r.randrange(1, 5)):
            w += r.choice(shared)[r.randrange(3) :] if r.random() < 0.6 else [word() for _ in range(r.randrange(30))]
        out.append(sep.join(w))
    return out


def brute_words(rows, k):
    first = {}
    words = [(t or "").encode().split() for _, t in rows]
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - k + 1):
            if d is not None:
                key = tuple(w[i : i + k])
                first[key] = min(d, first.get(key, d))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - k + 1):
            if d is not None and first[tuple(w[i : i + k])] < d:
                gone |= set(range(i, i + k))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(rows, k):
    count = {}
    raw = [(t or "").encode() for _, t in rows]
    for (d, _), b in zip(rows, raw, strict=True):
        for i in range(len(b) - k + 1):
            count[b[i : i + k]] = count.get(b[i : i + k], 0) + (d is not None)
    out = []
    for (d, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - k + 1):
            if d is not None and count[b[i : i + k]] > 1:
                gone[i : i + k] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((d, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


ODD = [(900, None), (901, ""), (902, "a a a a a a a a a a a a a a a a a a a a"), (903, "a " * 40), (None, "a " * 60), (904, "é ü " * 30), (904, "é ü " * 30), (905, "one\n\ttwo")]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 7) for d, t in rows], "doc_id long, text string, sha string, start int")


@pytest.mark.parametrize("hot", [4000, 1])
def test_words_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_STRINGS", hot)
    rows = [*enumerate(passages(1, 150)), *ODD, (77, passages(1, 150)[0])]
    got = sorted((tuple(r) for r in substring_dedup(frame(spark, rows), k=12, m=4).collect()), key=str)
    assert got == brute_words(rows, 12)


@pytest.mark.parametrize("hot", [4000, 1])
def test_bytes_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_STRINGS", hot)
    rows = [*enumerate(passages(2, 120)), *ODD]
    got = sorted((tuple(r) for r in suffix_dedup(frame(spark, rows), k=32, m=8).collect()), key=str)
    assert got == brute_bytes(rows, 32)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(none).count() == 0
    assert suffix_dedup(none).count() == 0


def test_collection_is_a_suffix_array_with_common_prefixes():
    r = random.Random(3)
    strings = [bytes(r.choice(b"abc") for _ in range(r.randrange(30))) for _ in range(25)]
    place, lcp = collection([np.frombuffer(s, np.uint8) for s in strings], 9)
    suffixes, at = [], 0
    for i, s in enumerate(strings):
        suffixes += [([*s[j:], 0, i], at + j) for j in range(len(s) + 1)]
        at += len(s) + 1
    suffixes.sort()
    assert place.tolist() == [p for _, p in suffixes]
    for i in range(1, len(suffixes)):
        a, b = suffixes[i - 1][0][:-2], suffixes[i][0][:-2]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert lcp[i] == min(n, 9)


@pytest.mark.parametrize("k", [8, 12, 7])
def test_repeated_equals_brute_force(k):
    r = random.Random(k)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randrange(90))) for _ in range(20)]
    count = {}
    for s in strings:
        for i in range(len(s) - k + 1):
            count[s[i : i + k]] = count.get(s[i : i + k], 0) + 1
    assert [x.tolist() for x in repeated(strings, k)] == [[count[s[i : i + k]] > 1 for i in range(len(s) - k + 1)] for s in strings]


def test_a_round_inserts_eight_bytes_of_every_string(monkeypatch):
    r = random.Random(8)
    body = bytes(r.randrange(256) for _ in range(336))
    strings = [body[: r.randrange(300)] + bytes([r.randrange(256)]) + body for _ in range(6)]
    strings = [b"", b"abc", *(s[-336:] for s in strings), body[5:300] + b"x" * 41]
    rounds = []
    monkeypatch.setattr(suffix_dedup_module, "range_minima", lambda *a: rounds.append(1) or range_minima(*a))
    got = repeated(strings, 200)
    count = {}
    for s in strings:
        for i in range(len(s) - 199):
            count[s[i : i + 200]] = count.get(s[i : i + 200], 0) + 1
    assert [x.tolist() for x in got] == [[count[s[i : i + 200]] > 1 for i in range(len(s) - 199)] for s in strings]
    assert len(rounds) <= 336 // 8


@pytest.mark.parametrize("unit", [repeats.Bytes, repeats.Words])
def test_runs_do_not_depend_on_slices(monkeypatch, unit):
    texts = [None, "", *passages(4, 30), "", passages(4, 30)[2], "short", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    out = []
    for size in (1, 300, 1 << 20):
        monkeypatch.setattr(repeats, "SLICE", size, raising=True)
        out.append([r for b in repeats._runs(unit, 24, 7)(iter([batch])) for r in b.to_pylist()])
    assert out[0] == out[1] == out[2]
    assert [sum(r["n"] for r in x["runs"]) for x in out[0]] == [max(0, x["size"] - 23) for x in out[0]]
    assert out[0][4]["runs"] == out[0][-3]["runs"] != []


def test_windows_of_packed_verdicts():
    bits = [[1, 0, 0, 1, 1, 0, 0, 0, 1], None, [0, 0], [], [0] * 15 + [1]]
    rows = [{"start": 100 * i, "n": len(b or [1]), "many": None if b is None else np.packbits(np.array(b, bool)).tobytes()} for i, b in enumerate(bits)]
    kind = pa.struct([("start", pa.int32()), ("n", pa.int32()), ("many", pa.binary())])
    at = lambda a, b: [100 * i + j for i in range(a, b) for j, x in enumerate(bits[i] or []) if x]
    for a, b in [(0, 5), (1, 5), (2, 4), (1, 2), (5, 5)]:
        assert suffix_dedup_module.windows(pa.array(rows, kind)[a:b]).tolist() == at(a, b)


def test_range_minima():
    a = np.random.default_rng(1).integers(0, 250, 1000).astype(np.uint8)
    lo = np.random.default_rng(2).integers(0, 1000, 400)
    hi = np.minimum(1000, lo + 1 + np.random.default_rng(3).integers(0, 500, 400))
    assert range_minima(a, lo, hi).tolist() == [a[i:j].min() for i, j in zip(lo, hi, strict=True)]


def test_runs_cover_every_window_once_and_equal_windows_share_minimisers():
    r = random.Random(5)
    sym = mix(np.array([r.randrange(6) for _ in range(600)], np.uint64))
    off = np.array([0, 0, 200, 210, 600])
    text, start, count, mh, _, _ = minimiser_runs(sym, off, 20, 5)
    seen, of = set(), {}
    for t, s, n, h in zip(text.tolist(), start.tolist(), count.tolist(), mh.tolist(), strict=True):
        for i in range(s, s + n):
            assert (t, i) not in seen
            seen.add((t, i))
            key = sym[off[t] + i : off[t] + i + 20].tobytes()
            assert of.setdefault(key, h) == h
    assert len(seen) == 181 + 371
