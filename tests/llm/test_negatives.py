import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import negatives
from touchline.llm.negatives import Best, Rows, Tables, fit_codebooks, hard_negatives, largest_code, meet, products, quantise

SCHEMA = "vec_id long, embedding array<double>, label int, rank string"


def brute(rows):
    """By the definition, with Python's integers."""
    part = []
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        codes = [math.floor(256 * x) for x in v]
        if all(abs(c) <= largest_code(len(v)) for c in codes):
            part.append((i, codes, label))
    out = []
    for a, q, mine in {(i, tuple(v), label) for i, v, label in part if i % 5 == 0}:
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, label) for i, v, label in part if i != a and len(v) == len(q))
        for s, p, _ in [r for r in scored if r[2] == mine][:5]:
            window = [(t, n) for t, n, label in scored if label != mine and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a, p, k, n, -s, -t) for k, (t, n) in enumerate(window[:3], 1)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in hard_negatives(df, F.col("vec_id") % 5 == 0).collect())


def vectors(rng, n, dim=6, labels=3):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(7)]
    return [(i, [float(round(c + rng.gauss(0, 0.4), rng.choice([1, 6]))) for c in rng.choice(centres)], rng.randrange(labels), "x") for i in range(n)]


@pytest.mark.parametrize("anchors, segment", [(1 << 16, 1 << 20), (3, 40)])
def test_against_brute_force(spark, monkeypatch, anchors, segment):
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    monkeypatch.setattr(negatives, "SEGMENT", segment)
    rng = random.Random(anchors)
    rows = vectors(rng, 160) + [(200 + i, v, label, x) for i, v, label, x in vectors(rng, 40, dim=9)]
    rows += [rows[3], rows[5], rows[10], (15, rows[2][1], 1, "x"), (400, [1.0] * 4, 0, "alone"), (401, [], 0, "x"), (405, [], 0, "x"), (406, [], 1, "x")]
    rows += [(500, None, 1, "x"), (505, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, "x"), (None, [1.0] * 6, 1, "x"), (510, [1.0] * 6, None, "x"), (515, [math.inf] * 6, 1, "x"), (520, [math.nan] * 6, 1, "x"), (525, [1e300] * 6, 1, "x"), (530, [0.0] * 6, 2, "x")]
    want = brute(rows)
    assert len(want) > 100 and mined(spark.createDataFrame(rows, SCHEMA).repartition(3)) == want


def test_ties_copies_and_empty_tables(spark):
    rows = [(i, [1.0, 0.5], i % 2, "x") for i in range(30)] + [(30 + i, [0.8, 0.4], i % 2, "x") for i in range(30)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    none = spark.createDataFrame([], SCHEMA)
    assert mined(none) == [] and mined(spark.createDataFrame([(1, [1.0], 1, "x")], SCHEMA)) == []


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for scale in (3, 200, 2**20):
        x, q = (np.rint(rng.normal(0, scale, (n, 10))).astype(np.int64) for n in (300, 40))
        books = fit_codebooks([v for v in x[:20]] + [v[:7] for v in x[:5]])
        codes, norms = quantise(x, books)
        about, error = Tables.of(q, books).bounds(codes, norms)
        exact = products(x, q)
        assert (np.abs(exact - about.astype(float)) <= error).all()
        assert error.mean() < np.linalg.norm(x, axis=1).mean() * np.linalg.norm(q, axis=1).mean()


def test_products_of_large_codes_are_exact():
    most = largest_code(3)
    x, y = np.array([[most, most, -7]]), np.array([[most, most - 1, 5]])
    assert products(x, y)[0, 0] == most * most + most * (most - 1) - 35 < negatives.LARGEST_SCORE


def test_best_rows_of_slots(monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS_AT_ONCE", 5)
    rng = np.random.default_rng(4)
    x, label = rng.integers(-4, 5, (500, 8)), rng.integers(0, 3, 500)
    ids = rng.permutation(500)
    anchors = Rows(ids[:23], label[:23], x[:23], None, None)
    low = rng.integers(-20, 60, 23 * 2)
    best = Best(np.repeat(np.arange(23), 2), low, low + rng.integers(0, 40, 46), 3, 23)
    books = fit_codebooks(list(x[:50]))
    for begin in range(0, 500, 70):
        codes, norms = quantise(x[begin : begin + 70], books)
        meet(best, anchors, Rows(ids[begin : begin + 70], label[begin : begin + 70], x[begin : begin + 70], codes, norms), books, same_label=False)
    found = defaultdict(list)
    for s in range(46):
        a = s // 2
        window = sorted((-int(x[a] @ x[k]), int(ids[k])) for k in range(500) if label[k] != label[a] and low[s] <= x[a] @ x[k] <= best.high[s])[:3]
        found[s] = [(-int(v), int(i)) for v, i in zip(best.score[s], best.id[s]) if v > Best.EMPTY]
        assert found[s] == window
