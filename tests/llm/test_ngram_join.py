import random
import re

import pytest

from rillflow.llm.ngram_join import Measure, jaccard_components


def brute(rows, k, num, den):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if (same or (both and den * both >= num * len(sets[i] | sets[j]))) and None not in (rows[i][0], rows[j][0]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = d if least.get(find(i)) is None else min(least[find(i)], d)
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def near_texts(seed, n, sizes, edit):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocab) for _ in range(r.choice(sizes))] for _ in range(6)]
    out = []
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.randrange(edit + 1)):
            i = r.randrange(len(w))
            w[i : i + r.randrange(2)] = [r.choice(vocab)] if r.random() < 0.8 else []
            if not w:
                w = ["x"]
        out.append(" ".join(w))
    return out


def run(spark, rows, k, num, den):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, component_id string, key long")
    return sorted((tuple(r) for r in jaccard_components(df, k, num, den).collect()), key=str)


@pytest.mark.parametrize("k,num,den,sizes,edit", [(3, 90, 100, [3, 5, 9, 12, 14], 1), (3, 90, 100, [18, 22, 25, 40], 2), (3, 90, 100, [150, 300], 6), (5, 80, 100, [10, 20, 30, 120], 4)])
def test_components_equal_brute_force(spark, k, num, den, sizes, edit):
    texts = near_texts(k + len(sizes) + edit, 260, sizes, edit)
    rows = list(enumerate(texts))
    assert run(spark, rows, k, num, den) == brute(rows, k, num, den)


def test_defined_cases(spark):
    long = " ".join(f"a{i}" for i in range(60))
    rows = [(5, None), (6, ""), (7, " \n"), (8, "One two"), (3, "one  TWO"), (9, "one two three"), (1, long), (1, long), (2, long + " z"), (None, long), (4, "É a b c"), (10, "é a b c")]
    got, want = run(spark, rows, 3, 90, 100), brute(rows, 3, 90, 100)
    assert got == want
    assert (None, 58, None) in got
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("words", [9, 60])
def test_an_id_with_a_copied_text_keeps_its_others(spark, words):
    a, b = (" ".join(f"{c}{i}" for i in range(words)) for c in "ab")
    near = b + " more"
    rows = [(3, a), (5, a), (5, b), (9, near)]
    assert run(spark, rows, 3, 80, 100) == brute(rows, 3, 80, 100)
    rows += [(12, b), (13, b), (5, None), (20, "c " + a), (2, "c " + a)]
    assert run(spark, rows, 3, 80, 100) == brute(rows, 3, 80, 100)


def test_blocks_settle_what_the_pivot_does_not(spark, monkeypatch):
    from rillflow.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    rows = list(enumerate(near_texts(11, 200, [120], 9)))
    assert run(spark, rows, 3, 90, 100) == brute(rows, 3, 90, 100)


def test_measure_matches_definition():
    m = Measure(90, 100)
    for n in range(1, 60):
        for k in range(1, 60):
            for o in range(0, min(n, k) + 1):
                assert (100 * o >= 90 * (n + k - o)) == (o >= m.need(n, k))
