import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from touchline.llm.trie import DIGEST, Blocks, common_turns, conversation_trie, conversations, prefix_trie, shared_start_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, parent string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows_of(convs):
    """convs: id to a list of (role, text)."""
    return [(c, k, role, text, "x", None) for c, turns in convs.items() for k, (role, text) in enumerate(turns)]


def rebuilt(convs, every=100, most=6):
    count = {c: zlib.crc32(str(c).encode()) % most for c in convs}
    return {c: convs.get(c - c % every, [])[: count[c]] + own[count[c] :] for c, own in convs.items()}


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for path, ids in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = lambda p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(path))
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        out.append((min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), kids(path), sum(kids(p) == 0 for p in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def some(rng, n, turns=4, words=3):
    """Conversations with many common starts, copies and starts of one another."""
    return {i * 3 + rng.randrange(3): [(rng.choice(["user", "assistant"]), "é" * rng.randrange(words)) for _ in range(rng.randrange(1, turns + 1))] for i in range(n)}


@pytest.mark.parametrize("partitions", [1, 2, 5, 23])
def test_against_brute_force(spark, partitions):
    rng = random.Random(partitions)
    for n, turns, words in ((60, 4, 2), (40, 9, 1), (25, 2, 6)):
        convs = some(rng, n, turns, words)
        assert got(conversation_trie(spark.createDataFrame(rows_of(convs), SCHEMA), partitions)) == brute(convs)


@pytest.mark.parametrize("partitions", [1, 7])
def test_shared_starts(spark, partitions):
    rng = random.Random(5)
    convs = {c: t for c, t in some(rng, 90, 8, 3).items() if c != 100}
    convs |= {0: [("user", "a"), ("assistant", "b")], 200: [("user", "long")] * 9, 201: [("user", "x")], 12_345_678_901: [("user", "x")] * 7}
    want = brute(rebuilt(convs))
    assert any(not t for t in rebuilt(convs).values()) and got(shared_start_trie(spark.createDataFrame(rows_of(convs), SCHEMA), partitions=partitions)) == want


def test_many_copies_and_a_long_conversation(spark):
    convs = {i: [("user", "same"), ("assistant", "answer")] for i in range(5000, 9000)}
    convs |= {i: [("user", "same"), ("assistant", f"{i}")] for i in range(300)}
    convs |= {20_000: [("user", f"{k}") for k in range(900)], 20_001: [("user", f"{k}") for k in range(700)]}
    rows = {(r["conv_id"], r["depth"]): r for r in conversation_trie(spark.createDataFrame(rows_of(convs), SCHEMA), 9).collect()}
    assert len(rows) == 1 + 1 + 301 + 900
    copies = rows[5000, 2]
    assert copies["ends_sha256"] == hashlib.sha256(",".join(map(str, range(5000, 9000))).encode()).hexdigest()
    assert (copies["n_convs"], copies["n_children"], copies["saved_tokens"], copies["parent_conv_id"]) == (4000, 0, 3999 * 6, 0)
    assert (rows[0, 0]["n_children"], rows[0, 1]["n_children"], rows[0, 0]["n_leaves"]) == (2, 301, 302)
    assert rows[20_000, 700]["n_convs"] == 2 and rows[20_000, 701]["n_convs"] == 1 and rows[20_000, 701]["parent_conv_id"] == 20_000


def test_order_nulls_and_empty_tables(spark):
    rows = [(1, 2, "user", "second", "x", None), (1, None, None, "first", "x", None), (1, 3, "user", None, "x", None), (2, 0, "", "first", "x", None), (None, 0, "user", "lost", "x", None), (2, 7, "user", "second", "x", None)]
    rows += [(3, 0, "4:user", "x", "x", None), (4, 0, "4", ":userx", "x", None)]
    want = {1: [("", "first"), ("user", "second"), ("user", "")], 2: [("", "first"), ("user", "second")], 3: [("4:user", "x")], 4: [("4", ":userx")]}
    assert got(conversation_trie(spark.createDataFrame(rows, SCHEMA))) == brute(want)
    none = spark.createDataFrame([], SCHEMA)
    assert conversation_trie(none).count() == 0 and shared_start_trie(none).count() == 0
    turnless = spark.createDataFrame([(1, b"", []), (2, b"", [])], "conv_id long, digests binary, lengths array<long>")
    assert got(prefix_trie(turnless)) == brute({1: [], 2: []})
    # turns that agree in `turn` are in one order, whatever the rows' order
    tied = spark.createDataFrame([(1, 0, "user", t, "x", None) for t in "abcabc"], SCHEMA)
    orders = {conversations(tied.orderBy(F.rand(k))).first()["digests"] for k in range(4)}
    assert len(orders) == 1 and len(orders.pop()) == 6 * DIGEST


def test_common_turns():
    a, b = b"".join(bytes([k]) * DIGEST for k in range(9)), b"".join(bytes([k]) * DIGEST for k in (0, 1, 2, 9))
    assert (common_turns(a, b), common_turns(a, a), common_turns(a, b""), common_turns(b, b[: 2 * DIGEST]), common_turns(a[DIGEST:], b)) == (3, 9, 0, 2, 0)


def test_owners_against_search():
    rng = random.Random(1)
    for _ in range(50):
        n = rng.randrange(1, 20)
        shared, inner = [-1, *(rng.randrange(5) for _ in range(n - 1))], [rng.choice([None, *range(5)]) for _ in range(n)]
        blocks = Blocks([3 * k for k in range(n)], shared, inner)
        for k in range(n):
            for depth in range(6):
                least = [s if i is None else min(s, i) for s, i in zip(shared, inner)]
                want = k if depth > shared[k] else max(j for j in range(k) if least[j] < depth)
                assert blocks.owner(3 * k, depth) == 3 * want
