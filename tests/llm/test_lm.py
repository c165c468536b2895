import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from touchline.llm.common import remainder
from touchline.llm.hpyp import TABLED, _poisson, discount_of, draw_tables, hashed_gamma, log_stirling
from touchline.llm.lm import score_texts
from touchline.session import ship_package


def tokens(t):
    return (t or "").encode().lower().split() + [b""]


def out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def corpus(rng, n):
    syllables = ["th", "an", "er", "ing", "Ed", "é", "ou", "bra", "kel", "mor"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.choice([1, 1, 2, 3])))
    return [(i, " ".join(word() for _ in range(rng.randrange(0, 80)))) for i in range(n)]


def test_base_scores_and_known_tokens(spark, monkeypatch):
    from touchline.llm import lm

    monkeypatch.setattr(lm, "CHUNK", 2000)  # many chunks
    docs = corpus(random.Random(6), 300) + [(1000, None), (1001, ""), (1002, " a\x0bB\t"), (3, "again  again"), (None, "no id")]
    d = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, score string")
    got = score_texts(d, remainder("doc_id", 10) == 0).collect()
    c = Counter(w for i, t in docs if not out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted(((i, out(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for i, t in docs), key=str)
    assert sorted(((*tuple(r)[:5], round(r["base_score"], 6)) for r in got), key=str) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def brute(docs):
    """The same model with sequential restaurants: log10 probabilities with one table for each
    distinct dish, which is what all draws come to when no pair and no word comes twice."""
    train = [["", *(w.decode() for w in tokens(t))] for i, t in docs if not out(i)]
    pair = Counter(p for s in train for p in zip(s, s[1:]))
    word = Counter(w for s in train for w in s[1:])
    ones, twos = sum(v == 1 for v in pair.values()), sum(v == 2 for v in pair.values())
    d = discount_of(ones, twos)
    customers = Counter()
    opened = Counter()
    for u, w in pair:
        customers[w] += 1
        opened[u] += 1
    e = discount_of(sum(v == 1 for v in word.values()), sum(v == 2 for v in word.values()))
    total, types = sum(customers.values()), len(word)
    parent = lambda w: (max(0, customers[w] - e * (w in customers)) + (1 + e * types) / (types + 1)) / (1 + total)
    context = Counter(u for s in train for u in s[:-1])
    return lambda u, w: (max(0, pair[u, w] - d * ((u, w) in pair)) + (1 + d * opened[u]) * parent(w)) / (1 + context[u])


def test_against_plain_restaurants(spark):
    # no pair comes twice, and most of the parent's dishes have one customer, so nearly all tables are one
    rng = random.Random(1)
    words = [f"w{i}" for i in range(4000)]
    rng.shuffle(words)
    docs = [(i, " ".join(words[10 * i : 10 * i + 10])) for i in range(300)] + [(600 + i, f"{words[3000 + 2 * i]} new {words[3001 + 2 * i]}") for i in range(40)]
    p = brute(docs)
    got = {r["doc_id"]: r for r in score_texts(spark.createDataFrame(docs, "doc_id long, text string"), remainder("doc_id", 10) == 0).collect()}
    close = 0
    for i, t in docs[:300]:
        s = ["", *(w.decode() for w in tokens(t))]
        want = sum(math.log10(p(u, w)) for u, w in zip(s, s[1:]))
        close += abs(got[i]["score"] - want) < 0.02 * abs(want)  # the end has several tables in the parent
    assert close == 300


def test_all_short_texts_sum_to_one(spark):
    """Over the words, the unknown word and the end: the texts of up to 6 words, and what longer ones have left."""
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("ab") for _ in range(rng.choice([0, 0, 1, 1, 2])))) for i in range(400)]
    every, new = [""], [""]
    for _ in range(6):
        new = [f"{t} {w}".strip() for t in new for w in ("a", "b", "zz")]
        every += new
    rows = docs + [(10_000 + k, t) for k, t in enumerate(every)]
    got = {r["doc_id"]: 10 ** r["score"] for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 10_000).collect()}
    by_words = [sum(got[10_000 + k] for k, t in enumerate(every) if len(t.split()) == n) for n in range(7)]
    longer = by_words[6] ** 2 / (by_words[5] - by_words[6])  # they fall by a constant factor
    assert by_words[0] > 0.3 and abs(sum(by_words) + longer - 1) < 1e-3, (by_words, longer)


def gibbs(train, sweeps, burn, seed):
    """The model with explicit tables: every customer of a context, and of the parent, gets up and sits
    down again. Yields the predictive probability p(context, word) after each sweep."""
    rng = random.Random(seed)
    pairs = [p for s in train for p in zip(s, s[1:])]
    count, word = Counter(pairs), Counter(w for _, w in pairs)
    d = discount_of(*(sum(v == k for v in count.values()) for k in (1, 2)))
    e = discount_of(*(sum(v == k for v in word.values()) for k in (1, 2)))
    base, theta = 1 / (len(word) + 1), 1.0
    tables, up = {}, {}  # sizes of the tables by pair; of the parent's tables by word
    opened, customers, seats, parents = Counter(), Counter(), Counter(), 0

    def parent(w):
        t = up.get(w, [])
        return (sum(t) - e * len(t) + (theta + e * parents) * base) / (theta + sum(seats.values()))

    def sit(sizes, rate, new, discount):
        """The place a customer takes among sizes; len(sizes) for a new table."""
        x = rng.random() * (sum(sizes) - discount * len(sizes) + rate * new)
        for i, n in enumerate(sizes):
            x -= n - discount
            if x < 0:
                return i
        return len(sizes)

    def leave(sizes):
        x = rng.random() * sum(sizes)
        for i, n in enumerate(sizes):
            x -= n
            if x < 0:
                break
        sizes[i] -= 1
        if not sizes[i]:
            del sizes[i]
            return True
        return False

    for sweep in range(-1, sweeps):
        for u, w in pairs:
            mine = tables.setdefault((u, w), [])
            if sweep >= 0:
                customers[u] -= 1
                if leave(mine):
                    opened[u] -= 1
                    seats[w] -= 1
                    parents -= leave(up[w])
            at = sit(mine, theta + d * opened[u], parent(w), d)
            customers[u] += 1
            if at < len(mine):
                mine[at] += 1
                continue
            mine.append(1)
            opened[u] += 1
            above = up.setdefault(w, [])
            at = sit(above, theta + e * parents, base, e)
            seats[w] += 1
            if at < len(above):
                above[at] += 1
            else:
                above.append(1)
                parents += 1
        if sweep >= burn:
            yield lambda u, w: (sum(tables.get((u, w), [])) - d * len(tables.get((u, w), [])) + (theta + d * opened[u]) * parent(w)) / (theta + customers[u])


def test_against_explicit_tables_with_repeated_pairs(spark):
    rng = random.Random(8)
    follow = {w: rng.sample("abcdefgh", 3) for w in "abcdefgh"}
    docs = []
    for i in range(60):
        w, text = rng.choice("abcdefgh"), []
        for _ in range(rng.randrange(3, 14)):
            text.append(w)
            w = rng.choice(follow[w]) if w in follow and rng.random() < 0.8 else rng.choice("abcdefgh" + "ijklmnop")
        docs.append((i, " ".join(text)))
    train = [["", *(w.decode() for w in tokens(t))] for i, t in docs if not out(i)]
    chance, n = Counter(), 0
    for p in gibbs(train, 220, 20, 1):
        n += 1
        for s in ({("", *(w.decode() for w in tokens(t))) for _, t in docs}):
            for u, w in zip(s, s[1:]):
                chance[u, w] = chance[u, w] or 0
        for u, w in chance:
            chance[u, w] += p(u, w)
    got = {r["doc_id"]: r for r in score_texts(spark.createDataFrame(docs, "doc_id long, text string"), remainder("doc_id", 10) == 0).collect()}
    errors = []
    for i, t in docs:
        s = ["", *(w.decode() for w in tokens(t))]
        errors.append((got[i]["score"] - sum(math.log10(chance[p] / n) for p in zip(s, s[1:]))) / (len(s) - 1))
    assert abs(np.mean(errors)) < 0.01 and np.abs(errors).max() < 0.1, (np.mean(errors), np.abs(errors).max())


def test_context_counts(spark):
    rng = random.Random(2)
    names = [f"n{i}" for i in range(60)]
    follow = {w: rng.choice(names) for w in names}
    docs = []
    for i in range(300):
        w, text = rng.choice(names), []
        for _ in range(40):
            text.append(w)
            w = follow[w] if rng.random() < 0.9 else rng.choice(names)
        docs.append((i, " ".join(text)))
    shuffled = [(1000 + i, " ".join(rng.sample(t.split(), 40))) for i, t in docs[:50]]
    held = (F.col("doc_id") >= 1000) | (F.col("doc_id") < 50)
    rows = score_texts(spark.createDataFrame(docs + shuffled, "doc_id long, text string"), held).collect()
    got = {r["doc_id"]: r for r in rows}
    assert all(abs(r["perplexity"] - 10 ** (-r["score"] / r["n_tokens"])) < 1e-9 * r["perplexity"] for r in rows)
    kept, mixed = (sum(got[base + i]["score"] for i in range(50)) for base in (0, 1000))
    assert kept > sum(got[i]["base_score"] for i in range(50)) / 2 and kept > mixed / 2
    again = {r["doc_id"]: r["score"] for r in score_texts(spark.createDataFrame(docs + shuffled, "doc_id long, text string").repartition(3), held).collect()}
    assert all(abs(again[i] - got[i]["score"]) < 1e-9 * abs(again[i]) for i in again)  # runs agree, however rows are dealt


def test_no_training_rows_and_empty(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in score_texts(d, F.lit(True)).collect()}
    assert got[1]["train_tokens"] == 0 and got[1]["n_known"] == 0 and got[1]["score"] == got[2]["score"] == 0.0 and got[2]["perplexity"] == 1.0
    assert score_texts(d.limit(0), F.lit(False)).count() == 0


def test_table_counts_follow_their_distribution():
    rng = np.random.default_rng(0)
    d, theta, base, others, c = 0.5, 1.0, 0.2, 3, 6
    weight = np.array([math.exp(log_stirling(d)[c, t]) * base**t * math.prod(theta + d * (others + j) for j in range(t)) for t in range(1, c + 1)])
    n = 40_000
    drawn = draw_tables(np.full(n, c), np.full(n, math.log(base)), np.full(n, float(others)), theta, d, rng.random(n))
    share = np.bincount(drawn, minlength=c + 1)[1:] / n
    assert np.abs(share - weight / weight.sum()).max() < 0.01
    assert draw_tables(np.array([0, 1]), np.log([0.1, 0.1]), np.zeros(2), theta, d, np.zeros(2)).tolist() == [0, 1]
    # many customers: close to the exact mean
    c, base, log_s = 300, 0.05, np.array([0.0])
    for n in range(c):
        t = np.arange(1, n + 2)
        with np.errstate(divide="ignore"):
            log_s = np.concatenate([[-np.inf], np.logaddexp(log_s, np.append(np.log(np.maximum(n - d * t[:-1], 0)) + log_s[1:], -np.inf) if n else -np.inf)])
    t = np.arange(1, c + 1)
    log_p = log_s[1:] + t * math.log(base) + np.cumsum(np.log(theta + d * (10 + t - 1)))
    exact = (t * np.exp(log_p - log_p.max())).sum() / np.exp(log_p - log_p.max()).sum()
    many = draw_tables(np.full(4000, c), np.full(4000, math.log(base)), np.full(4000, 10.0), theta, d, rng.random(4000))
    assert abs(many.mean() - exact) < 0.1 * exact


def test_large_dishes_have_the_exact_mean_and_spread():
    theta, d, n = 1.0, 0.5, 8000
    for c, base, others in ((40, 0.01, 50), (300, 0.05, 10), (300, 0.001, 200), (1000, 0.01, 100), (1000, 0.002, 2000), (4000, 0.01, 100), (4000, 0.0005, 3000), (2500, 0.3, 20)):
        log_s = np.array([0.0])
        for k in range(1, c):
            log_s = np.logaddexp(np.append(np.log(k - d * np.arange(1, k + 1)) + log_s, -np.inf), np.append(-np.inf, log_s))
        t = np.arange(1, c + 1)
        log_p = log_s + t * math.log(base) + np.cumsum(np.log(theta + d * (others + t - 1)))
        p = np.exp(log_p - log_p.max())
        p /= p.sum()
        mean = (t * p).sum()
        drawn = draw_tables(np.full(n, c), np.full(n, math.log(base)), np.full(n, float(others)), theta, d, np.random.default_rng(c).random(n))
        assert abs(drawn.mean() - mean) < 0.02 * mean
        assert abs(drawn.var() - ((t - mean) ** 2 * p).sum()) < 0.15 * ((t - mean) ** 2 * p).sum()


def test_numbers_of_pairs_differ():
    from touchline.llm.lm import _scramble

    for bits in (2, 10, 16):
        x = np.arange(1 << bits, dtype=np.uint64)
        assert len(np.unique(_scramble(x, bits))) == 1 << bits and int(_scramble(x, bits).max()) < 1 << bits


def test_long_texts_and_many_buckets(spark, monkeypatch):
    from touchline.llm import lm

    docs = corpus(random.Random(7), 60) + [(999, "long text " * 40_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    one = {r["doc_id"]: tuple(r)[:6] for r in score_texts(d, remainder("doc_id", 10) == 0).collect()}
    monkeypatch.setattr(lm, "BUCKET", 5000)
    monkeypatch.setattr(lm, "CHUNK", 3000)
    many = {r["doc_id"]: r for r in score_texts(d, remainder("doc_id", 10) == 0).collect()}
    assert {i: tuple(r)[:5] for i, r in many.items()} == {i: r[:5] for i, r in one.items()}
    assert all(math.isfinite(r["score"]) for r in many.values()) and many[999]["n_tokens"] == 80_001


def exact_joint(customers, bases, theta, d):
    """Mean tables of each of two dishes of one restaurant, over all seatings."""
    log_s = log_stirling(d)
    t, u = (np.arange(1, c + 1) for c in customers)
    log_p = (log_s[customers[0], 1 : customers[0] + 1] + t * math.log(bases[0]))[:, None] + log_s[customers[1], 1 : customers[1] + 1] + u * math.log(bases[1])
    rising = np.concatenate([[0], np.cumsum(np.log(theta + d * np.arange(sum(customers))))])
    p = np.exp(log_p + rising[t[:, None] + u] - (log_p + rising[t[:, None] + u]).max())
    p /= p.sum()
    return float((p.sum(1) * t).sum()), float((p.sum(0) * u).sum())


def test_a_restaurant_of_several_dishes_follows_its_joint_law():
    theta, d, n = 1.0, 0.6, 4000
    for customers, bases in (((200, 3), (0.3, 0.05)), ((2, 2), (0.01, 0.02)), ((900, 400), (0.1, 0.3)), ((40, 8), (0.001, 0.5))):
        c, log_base = np.repeat(customers, n), np.log(np.repeat(bases, n))
        tables, keys, sums, kept = np.ones(2 * n), np.arange(n, dtype=np.uint64), np.zeros(2), 0
        for sweep in range(40):
            restaurant = tables[:n] + tables[n:]
            gamma = hashed_gamma(keys, theta / d + restaurant, sweep)
            tables = draw_tables(c, log_base, None, theta, d, np.random.default_rng(sweep).random(2 * n), np.tile(gamma, 2)).astype(float)
            if sweep >= 15:
                sums, kept = sums + [tables[:n].mean(), tables[n:].mean()], kept + 1
        want = exact_joint(customers, bases, theta, d)
        assert sums / kept == pytest.approx(want, rel=0.02), (customers, sums / kept, want)


def test_large_dishes_given_gamma():
    d, n = 0.5, 6000
    for c, z in ((1500, 0.3), (4000, 2.0), (4000, 40.0)):  # z: base d gamma
        log_s = np.array([0.0])
        for k in range(1, c):
            log_s = np.logaddexp(np.append(np.log(k - d * np.arange(1, k + 1)) + log_s, -np.inf), np.append(-np.inf, log_s))
        t = np.arange(1, c + 1)
        p = np.exp((log_p := log_s + t * math.log(z)) - log_p.max())
        p /= p.sum()
        mean = (t * p).sum()
        drawn = draw_tables(np.full(n, c), np.full(n, math.log(z / (d * 100))), None, 1.0, d, np.random.default_rng(c).random(n), np.full(n, 100.0))
        assert c > TABLED and abs(drawn.mean() - mean) < 0.02 * mean and abs(drawn.var() - ((t - mean) ** 2 * p).sum()) < 0.15 * ((t - mean) ** 2 * p).sum() + 0.02


def test_hashed_numbers():
    keys = np.arange(60_000, dtype=np.uint64)
    for shape in (0.3, 1.0, 1.7, 30.0, 5000.0):
        x = hashed_gamma(keys, np.full(len(keys), shape), 5)
        assert abs(x.mean() - shape) < 0.03 * shape and abs(x.var() - shape) < 0.06 * shape
    assert (hashed_gamma(keys[:5], np.full(5, 2.0), 1) == hashed_gamma(keys, np.full(len(keys), 2.0), 1)[:5]).all() and (hashed_gamma(keys[:3], np.zeros(3), 1) == 0).all()
    drawn = _poisson(np.repeat([0.0, 0.4, 90.0], 20_000), np.random.default_rng(2).random(60_000)).reshape(3, -1)
    assert drawn[0].max() == 0 and np.abs(drawn.mean(1)[1:] / [0.4, 90.0] - 1).max() < 0.03 and abs(drawn[2].var() / 90 - 1) < 0.05


def test_frequent_pairs_against_explicit_tables(spark):
    """Contexts with hundreds of customers, dishes with up to a hundred."""
    rng = random.Random(4)
    words = "abcdefghijkl"
    docs = [(i, " ".join(rng.choices(words, [2.0 ** -k for k in range(12)], k=rng.randrange(10, 40)))) for i in range(60)]
    train = [["", *(w.decode() for w in tokens(t))] for i, t in docs if not out(i)]
    assert max(Counter(p for s in train for p in zip(s, s[1:])).values()) > 150
    chance, n = Counter(), 0
    asked = {p for _, t in docs for s in [["", *(w.decode() for w in tokens(t))]] for p in zip(s, s[1:])}
    for p in gibbs(train, 90, 30, 2):
        n += 1
        for u, w in asked:
            chance[u, w] += p(u, w)
    got = {r["doc_id"]: r for r in score_texts(spark.createDataFrame(docs, "doc_id long, text string"), remainder("doc_id", 10) == 0).collect()}
    errors = []
    for i, t in docs:
        s = ["", *(w.decode() for w in tokens(t))]
        errors.append((got[i]["score"] - sum(math.log10(chance[p] / n) for p in zip(s, s[1:]))) / (len(s) - 1))
    assert abs(np.mean(errors)) < 0.005 and np.abs(errors).max() < 0.03, (np.mean(errors), np.abs(errors).max())


def test_batches_of_large_rows_are_small(spark):
    ship_package(spark)
    rows = spark.range(0, 40, 1, 1).select(F.expr("repeat('x', 1000000)").alias("x"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "bytes": [batch.nbytes]})

    found = rows.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r["n"] for r in found) == 40 and max(r["bytes"] for r in found) <= 10_000_000


def test_many_tables_are_summed_past_a_byte_and_past_the_largest_weight():
    # all customers sit alone where the base is huge, so weights grow beyond LARGEST and counts beyond 255
    c = np.array([300, 1000, 17, 1024])
    u = np.array([0.5, 0.2, 0.9, 0.7])
    got = draw_tables(c, np.zeros(4), None, 1.0, 0.5, u, np.full(4, 1e9))
    s = log_stirling(0.5)
    for k in range(4):
        t = np.arange(1, c[k] + 1)
        log_p = s[c[k], 1 : c[k] + 1] + t * np.log(0.5e9)
        p = np.exp(log_p - log_p.max())
        assert got[k] == 1 + int((np.cumsum(p) < u[k] * p.sum()).sum())


class Chunk:
    """Pairs of a chunk whose tables are what their keys say; notes which pairs it was asked to seat."""

    def __init__(self, keys, counts):
        self.keys, self.pair_count, self.asked = np.array(keys, np.uint64), np.array(counts, np.int64), []
        self.order = np.argsort(self.keys)

    def seat(self, row, sweep, some):
        self.asked.append(sorted(self.keys[some].tolist()))
        for chain in range(2):
            yield np.minimum(self.keys[some].astype(np.int64) + chain + sweep, self.pair_count[some])


def test_frequent_pairs_are_drawn_once_a_worker(monkeypatch):
    from touchline.llm import lm

    alone = lambda keys, counts: lm._kept_tables(Chunk(keys, counts), {}, lm._Frequent("")).tolist()
    first, second = ([5, 3, 9, 7, 1], [100, 2, 40, 1, 0]), ([9, 4, 5, 3], [40, 90, 100, 2])
    memory = lm._Frequent("run")
    assert lm._kept_tables(Chunk(*first), {}, memory).tolist() == alone(*first) == [28, 8, 44, 4, 0]
    again = Chunk(*second)
    assert lm._kept_tables(again, {}, memory).tolist() == alone(*second)
    assert again.asked == [[3, 4]] * 2  # of both sweeps: the rare pair, and the one not seen before
    assert memory.keys.tolist() == [4, 5, 9] and memory.counts.tolist() == [90, 100, 40]
    assert lm._frequent("x") is lm._frequent("x") and not len(lm._frequent("y").keys)

    monkeypatch.setattr(lm, "REMEMBERED", 8)
    small, rng = lm._Frequent("run"), random.Random(3)
    of = {k: rng.randrange(17, 200) for k in range(100)}
    for _ in range(30):
        keys = rng.sample(range(100), 20)
        counts = [of[k] for k in keys]
        assert lm._kept_tables(Chunk(keys, counts), {}, small).tolist() == alone(keys, counts)
        assert len(small.keys) <= 8 and (np.diff(small.keys.astype(np.int64)) > 0).all()
    assert len(small.keys) and small.counts.min() > 100  # those of most customers


def test_words_as_bytes_are_split():
    from touchline.llm.lm import _joined, _words

    texts = ["a", "Ä B\x1cc  D\n", None, "", " \t\x0b\x0c\r\n", " x Y z ", "É\u0085q w", "End"] * 3
    for array in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(texts).slice(1, 9), pa.array([], pa.string()), pa.array([None], pa.string())):
        want = [(t or "").encode().lower().split() for t in array.to_pylist()]
        words, sizes = _words(array)
        assert [w.encode() for w in words.to_pylist()] == [w for t in want for w in t]
        assert sizes.tolist() == [len(t) for t in want]
        assert b" ".join(_joined(words)) == b" ".join(w for t in want for w in t)


def test_shuffled_files_go_when_a_step_is_written(spark):
    from touchline.llm.lm import _by_chunk

    conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark.conf.set(conf, "false")  # as in a session of its own
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {n for n in files.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in n}
    before = shuffled()
    dealt = spark.range(1000).withColumn("chunk", F.col("id") % 7).repartition(3, "id")
    written = _by_chunk(dealt.groupBy("chunk").agg(F.count("*").alias("n")), 2)
    deadline = time.time() + 20
    while shuffled() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffled() - before
    assert sorted(r["n"] for r in written.collect()) == [142, 143, 143, 143, 143, 143, 143] and spark.conf.get(conf) == "false"
