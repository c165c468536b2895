import random
import re

import numpy as np

from touchline.llm.graph import connected_components
from touchline.llm.minhash import band_keys, deduplicate, estimated_similarity, link_parts, minima, mismatches, near_duplicates, pack, shingle_set
from touchline.llm.common import WordCodes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs, percent=85):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    return {docs[i][0]: (len(sets[i]), min(docs[j][0] for j in range(len(docs)) if root[j] == root[i])) for i in range(len(docs))}


def corpus(rng, families, each, length):
    vocabulary = [f"w{i}" for i in range(500)] + ["É", "x y"]
    docs = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(length)]
        for _ in range(each):
            words = list(base)
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            docs.append(words)
    return docs


def test_against_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(w) for w in corpus(rng, 6, 12, 110) + corpus(rng, 5, 6, 6) + corpus(rng, 1, 30, 60)]
    texts += [texts[0].upper(), texts[0].replace(" ", "\n\t"), None, "", " \x0b ", "one two", "ONE two", "one", "z " * 3000, "z " * 50]
    ids = rng.sample(range(10_000), len(texts))
    docs = list(zip(ids, texts))
    d = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, component_id string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(d).collect()}
    assert got == brute(docs)
    kept = {r["doc_id"] for r in deduplicate(d).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}


def test_repeated_ids_nulls_and_empty(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(5, text), (5, text), (5, "other words"), (7, text), (None, text), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(d).collect()), key=str)
    assert got == sorted([(5, 36, 5, True), (5, 36, 5, True), (5, 1, 5, True), (7, 36, 5, False), (None, 36, None, False), (None, 0, None, False)], key=str)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(none).count() == 0 and deduplicate(none).count() == 0
    left = sorted(((r["doc_id"], r["text"]) for r in deduplicate(d).collect()), key=str)
    assert left == sorted([(5, text), (5, "other words"), (None, text), (None, None)], key=str)


def test_deduplicate_keeps_other_texts_of_an_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(5, a, 1, "x"), (5, b, 2, "x"), (7, b, 3, "x"), (9, a + " more", 4, "x"), (5, a.upper(), 5, "x"), (8, "", 6, "x"), (8, "", 7, None), (6, "alone", 8, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, digest int, Among string")
    got = deduplicate(d)
    assert got.columns == d.columns
    assert sorted((r["doc_id"], r["text"], r["digest"]) for r in got.collect()) == sorted([(5, a.upper(), 5), (5, b, 2), (6, "alone", 8), (8, "", 6), (8, "", 7)])
    assert got.filter("Among is null").first()["digest"] == 7


def test_wanted_ids_are_all_found(spark, monkeypatch):
    from touchline.llm import minhash

    d = spark.range(-3000, 3000).withColumnRenamed("id", "doc_id")
    wanted = d.filter("doc_id % 7 = 3")
    for bits in (1 << 26, 1 << 16):
        monkeypatch.setattr(minhash, "ID_BITS", bits)
        among = {r["doc_id"] for r in minhash._with_ids(d, wanted).filter("among").collect()}
        assert among >= {r["doc_id"] for r in wanted.collect()} and len(among) < 1.2 * wanted.count()


def test_hot_buckets_agree(spark, monkeypatch):
    from touchline.llm import select

    rng = random.Random(9)
    docs = [(i, " ".join(w)) for i, w in enumerate(corpus(rng, 1, 60, 70))] + [(1000 + i, "the same few words again") for i in range(50)]
    monkeypatch.setattr(select, "HOT", 4)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(d).collect()} == brute(docs)


def test_estimate_is_corrected():
    rng = np.random.default_rng(0)
    errors = []
    for share in (0.2, 0.5, 0.85, 1.0):
        for _ in range(30):
            a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
            b = a.copy()
            n = int(400 * (1 - share) / (1 + share))
            b[:n] = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            packed = pack(np.stack([minima(a), minima(b)]))
            errors.append(estimated_similarity(mismatches(packed[0], packed[1])) - (400 - n) / (400 + n))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def test_tiles_agree_with_one_block(spark, monkeypatch):
    from touchline.llm import minhash

    rng = random.Random(8)
    docs = [(i, " ".join(w)) for i, w in enumerate(corpus(rng, 2, 40, 70))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(minhash, "TILE", 8)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(d).collect()} == brute(docs)


def test_parts_and_components(spark):
    codes = WordCodes()
    sets = [shingle_set(t.encode(), codes, 1) for t in ("a b c d e f", "a b c d e f g", "b c d e f g h", "x", "x", "q r")]
    assert link_parts(sets, 70).tolist() == [0, 0, 0, 3, 3, 5]
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {n: find(n) for n in root if any(n in p and p[0] != p[1] for p in pairs)}
    got = connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
    assert band_keys(np.stack([minima(s) for s in sets[:2]]), 25, 5).shape == (2, 25)
