import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import sharding
from touchline.llm.sharding import even_cuts, plan_shards, shard_of, shard_report, smallest_capacity, text_hash, with_slots, write_shards


def least(sizes, shards):
    """The smallest largest run, by trying all cuts."""
    n = len(sizes)
    sums = [0, *np.cumsum(sizes).tolist()]
    best = [[10**18] * (shards + 1) for _ in range(n + 1)]
    best[0] = [0] * (shards + 1)
    for i in range(1, n + 1):
        for k in range(1, shards + 1):
            best[i][k] = min(max(best[j][k - 1], sums[i] - sums[j]) for j in range(i))
    return best[n][shards]


def test_capacity_and_cuts_against_all_partitions():
    rng = random.Random(2)
    for _ in range(150):
        sizes = np.array([rng.choice([1, 2, 5, 40]) * rng.randint(1, 9) for _ in range(rng.randint(1, 14))])
        shards = rng.randint(1, 6)
        capacity = smallest_capacity(sizes, shards)
        assert capacity == least(sizes.tolist(), shards)
        sums = np.concatenate([[0], np.cumsum(sizes)])
        at = [0, *even_cuts(sums, shards, capacity), len(sizes)]
        assert at == sorted(at) and max(int(sums[b] - sums[a]) for a, b in zip(at, at[1:])) <= capacity


def groups_of(spark, docs):
    """Sizes of groups of equal texts, in order of their hashes."""
    sizes = Counter()
    for _, text in docs:
        sizes[text or ""] += len((text or "").encode()) + 8
    hashed = spark.createDataFrame([(t,) for t in sizes], "text string").withColumn("h", text_hash(F.col("text"))).collect()
    return [sizes[r["text"]] for r in sorted(hashed, key=lambda r: r["h"])]


def check(spark, docs, shards):
    rows = shard_report(spark.createDataFrame(docs, "doc_id long, text string"), shards).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    totals, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        totals[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[r["text_crc32"]].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in homes.values()) and set(totals) <= set(range(shards))
    assert max(totals.values()) <= least(groups_of(spark, docs), shards)
    return totals


@pytest.mark.parametrize("bits, cells", [(14, 1 << 18), (2, 16), (1, 4)])
def test_shards_against_all_partitions(spark, monkeypatch, bits, cells):
    monkeypatch.setattr(sharding, "FIRST_BITS", bits)
    monkeypatch.setattr(sharding, "CELLS", cells)
    rng = random.Random(bits)
    docs = [(i, "x" * rng.choice([1, 3, 30, 200]) + f"é{rng.randint(0, 60)}") for i in range(90)]
    docs += [(7, None), (7, ""), (None, "same"), (8, "same"), (8, "same"), (9, "long " * 2000)]
    check(spark, docs, 5)
    check(spark, docs[:3], 24)


def test_a_group_of_a_third_of_the_rows(spark):
    docs = [(i, "copy of one text") for i in range(900)] + [(i, f"text number {i}") for i in range(900, 2700)]
    totals = shard_report(spark.createDataFrame(docs, "doc_id long, text string"), 24).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    sizes = sorted(r["s"] for r in totals)
    assert len(totals) == 24 and sizes[-1] == 900 * (16 + 8) and sizes[0] > 0.8 * sizes[-2]


def test_empty_table_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, shard string")
    assert shard_report(none, 24).count() == 0
    plan = plan_shards(none, 3)
    assert plan.capacity == 0 and none.select(shard_of(plan, F.col("text"))).count() == 0
    same = spark.range(9000).select(F.lit(1).alias("doc_id"), F.lit(0).alias("shard"))
    assert sorted(r["slot"] for r in with_slots(same).collect()) == list(range(9000))


def test_written_shards_and_reruns_agree(spark, tmp_path):
    docs = spark.range(300).select("id", F.concat(F.lit("t"), F.col("id") % 70).alias("text"), F.lit("old").alias("shard"))
    plan = plan_shards(docs, 70 + 30)  # more shards than groups
    assert plan == plan_shards(docs.repartition(7), 100)
    write_shards(docs, plan, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["id"] for r in back.collect()) == list(range(300))
    assert back.groupBy("text").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count() == 0
    first = shard_report(docs.withColumnRenamed("id", "doc_id"), 5).collect()
    assert sorted(first) == sorted(shard_report(docs.withColumnRenamed("id", "doc_id").repartition(5), 5).collect())
