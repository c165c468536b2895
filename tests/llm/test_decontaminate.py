import hashlib
import random
import re

import pytest

from touchline.llm.decontaminate import contamination_report, find_contamination, remove_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    out = {}
    for doc, text in docs:
        w = words(text)
        hit, names = set(), set()
        for name, item in items:
            iw = words(item)
            size = min(window, len(iw))
            if not iw:
                continue
            grams = {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)}
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in grams:
                    hit |= set(range(i, i + size))
                    if name is not None:
                        names.add(str(name))
        out[doc] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("window,block", [(3, 10**6), (4, 6)])
def test_against_brute_force(spark, window, block):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("ab c7 É d".split()) for _ in range(n))
    items = [(i, text(rng.randrange(0, 12))) for i in range(12)] + [(None, "x y z x y z"), (3, "x x x"), (77, None)]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(80)] + [(100, None), (101, ""), (102, "--- !!"), (103, "X y, z X-y z")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = find_contamination(d, b, window, block).select("doc_id", "n_words", "spans", "items").collect()
    want = brute(docs, items, window)
    for r in found:
        names = sorted(r["items"])
        n_hit = sum(r["spans"][1::2]) - sum(r["spans"][::2])
        assert (r["n_words"], n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n_hit > 0) == want[r["doc_id"]]
    report = {r["doc_id"]: tuple(r)[1:6] for r in contamination_report(d, b, window).collect()}
    assert report == want


def test_removal_keeps_the_rest(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Before it. One, two three four FIVE six seven eight nine ten; eleven! After it all {'word ' * 30}", 0, "s"), (2, item, 0, "s"), (3, "clean  text", 11, None), (4, None, None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, n_chars long, items string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in remove_contamination(d, b).collect()}
    assert sorted(got) == [1, 3, 4]
    assert got[1]["text"].startswith("Before it. ! After it all") and got[1]["n_chars"] == len(got[1]["text"])
    assert got[3]["text"] == "clean  text" and got[1]["items"] == "s"


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert contamination_report(d, b).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert contamination_report(one, b).first()["contaminated"] is False


def test_repetitive_and_very_long_texts_take_linear_time():
    import time

    from touchline.llm.decontaminate import SuffixAutomaton

    same = [(k, [b"a"] * 20_000) for k in range(3)] + [(10, [b"a"] * 4), (11, [b"a"] * 4), (12, [b"a"] * 2)]
    found = SuffixAutomaton(same, 10)
    begun = time.time()
    spans, items, longest = found.scan([b"a"] * 200_000)
    assert spans == [0, 200_000] and items == {0, 1, 2, 10, 11, 12} and longest == 20_000
    assert time.time() - begun < 3


def test_short_items_within_others(spark):
    items = [(1, "a b c"), (2, "b c"), (3, "c"), (4, "x a b c d e f g h i j k l"), (5, "b c"), (6, "a b")]
    docs = [(1, "z a b c z"), (2, "a b z"), (3, "b c c"), (4, "x a b c d e f g h i j"), (4, "x a b c d e f g h i j"), (5, "a a b")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (10**6, 3):
        got = {r["doc_id"]: tuple(r)[1:6] for r in contamination_report(d, b, 10).collect()} if block > 3 else {
            r["doc_id"]: r for r in find_contamination(d, b, 10, block).collect()
        }
        want = brute(docs, items, 10)
        if block > 3:
            assert got == want
        else:
            assert {k: (r["n_words"], sum(r["spans"][1::2]) - sum(r["spans"][::2]), len(r["items"])) for k, r in got.items()} == {k: v[:3] for k, v in want.items()}
