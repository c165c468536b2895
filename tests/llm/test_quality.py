import random

import numpy as np

from touchline.llm.quality import BUCKETS, bucket_counts, gumbel_top, log_ratios, resample


def test_resampling_keeps_targets(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["th", "an", "er", "ing", "ou"]) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(1000):
        words = [word() for _ in range(rng.randrange(5, 80))]
        good = rng.random() < 0.8
        if not good:
            words = [w + "%%%" for w in words] if i % 2 else ["same"] * (len(words) + 10)
        rows.append((i, " ".join(words), "x"))
        if i % 3:
            labels.append((i, int(good)))
    rows += [(5000, None, "x"), (5001, "", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    known = spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in resample(d, known).collect()}
    assert len(got) == len(rows) and got[5000]["log_weight"] == got[5001]["log_weight"] == 0
    share = sum(q for _, q in labels) / len(labels)
    assert sum(r["kept"] for r in got.values()) == round(len(rows) * share)
    bad = [i for i, t, _ in rows if t and ("%%%" in t or "same same" in t)]
    assert sum(got[i]["kept"] for i in bad) < 0.15 * len(bad)
    assert {k for k, r in got.items() if r["kept"]} == {r["doc_id"] for r in resample(d.repartition(5), known).collect() if r["kept"]}


def test_exact_top_k_and_edges(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0.0, 1.0, rng.gauss(0, 50)])) for i in range(500)]
    d = spark.createDataFrame(rows, "doc_id long, log_weight double")
    for k in (0, 1, 137, 500):
        got = gumbel_top(d, k).collect()
        want = sorted(got, key=lambda r: (-r["gumbel_key"], r["doc_id"]))[:k]
        assert {r["doc_id"] for r in got if r["kept"]} == {r["doc_id"] for r in want}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample(none, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resample(one, spark.createDataFrame([], "doc_id long, quality int")).first()["kept"]


def test_counts_are_of_the_whole_text():
    counts = bucket_counts("ab ab ab c" * 3)
    assert counts[:-2].sum() == 28 and counts[-2:].tolist() == [2 + 1 + 1, 9 - 4] or counts[-2:].sum() == 9
    assert bucket_counts(None).sum() == 0 and bucket_counts("xx").sum() == 0
    assert not log_ratios(np.ones(BUCKETS), np.zeros(BUCKETS)).any()


def test_weights_by_brute_force(spark):
    """Trigrams counted one by one, the two models and the documents' weights from plain dictionaries."""
    import math
    from collections import Counter

    from touchline.llm.quality import fit_ratio, weigh

    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "beta", "über", "x"]) for _ in range(rng.randrange(0, 40)))) for i in range(60)] + [(60, "long " * 50_000), (61, None), (3, "again again")]
    labels = [(i, int(i % 3 == 0)) for i in range(40)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")

    def counts(text):
        found = Counter()
        for a, b, c in zip(text or "", (text or "")[1:], (text or "")[2:]):
            h = ((ord(a) << 42) ^ (ord(b) << 21) ^ ord(c)) * 0x9E3779B97F4A7C15 % 2**64
            found["gram", h >> 49] += 1
        words = (text or "").split()
        for a, b in zip(words, words[1:]):
            found["repeat", a == b] += 1
        return found

    raw, target = Counter(), Counter()
    for i, t in docs:
        raw += counts(t)
        if i < 40 and i % 3 == 0:
            target += counts(t)

    def log_share(model, key):
        size = 2**15 if key[0] == "gram" else 2
        return math.log((model[key] + 1) / (sum(n for k, n in model.items() if k[0] == key[0]) + size))

    ratios, share = fit_ratio(d, known)
    assert share == sum(q for _, q in labels) / len(labels)
    got = weigh(d, ratios).collect()
    for r in got:
        want = sum(n * (log_share(target, k) - log_share(raw, k)) for k, n in counts(r["text"]).items())
        assert abs(r["log_weight"] - want) < 1e-6 * max(1, abs(want))
