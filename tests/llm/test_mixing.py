import random

from touchline.llm.mixing import mix


def targets(sizes, weights=(1, 2, 3)):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in stopped]
        share = total - sum(stopped.values())
        t = {s: share * w[s] / sum(w[x] for x in free) for s in free}
        above = [s for s in free if t[s] > 3 * sizes[s]]
        if not above:
            return {**t, **stopped}
        stopped |= {s: 3 * sizes[s] for s in above}


def test_targets_and_takes(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        source = rng.choices(["a", "B", "é", None, "z", "tiny"], [30, 40, 20, 5, 200, 1])[0]
        rows.append((i, " ".join("w" * rng.randrange(1, 60)), source, "x"))
    rows += [(9001, None, "a", "x"), (9002, "  ", "a", "x"), (9003, "a\tb\x0bc", "B", "x"), (9003, "a\tb\x0bc", "B", "x"), (9004, None, "nothing", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    got = mix(d).collect()
    again = {(r["doc_id"], r["taken"]) for r in mix(d.repartition(7)).collect()}
    assert {(r["doc_id"], r["taken"]) for r in got} == again and len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    want = targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
    for s in want:
        assert abs(taken[s] - want[s]) <= 30


def test_importance_and_edges(spark):
    d = spark.createDataFrame([(i, "w " * 10, "s", float(i % 2)) for i in range(200)] + [(1000, "w " * 10, "t", 1.0)], "doc_id long, text string, source string, imp double")
    taken = {r["doc_id"]: r["copies"] for r in mix(d, importance="imp").collect()}
    assert sum(v for k, v in taken.items() if k % 2 == 0 and k < 1000) == 0
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(none).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [r["taken"] for r in mix(blank).collect()] == [0, 0]


def test_pareto_order_by_hand(spark):
    """Who is drawn, from the same random numbers: ranks of odds, taken until the words come nearest."""
    from pyspark.sql import functions as F

    from touchline.llm.select import unit_interval

    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randrange(1, 40)), f"s{i % 4}" if i % 9 else None) for i in range(2000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mix(d, seed=42).collect()}
    u = {r["doc_id"]: r["u"] for r in d.select("doc_id", unit_interval(F.lit(42), F.col("doc_id")).alias("u")).collect()}
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    for source, target in targets(sizes).items():
        ours = [(i, len(t.split())) for i, t, s in rows if s == source]
        share = min(3.0, target / sizes[source])
        whole, part = int(share), share - int(share)
        so_far, left, drawn = 0, target - whole * sizes[source], set()
        for i, n in sorted(ours, key=lambda x: u[x[0]] / (1 - u[x[0]])) if part else []:
            if so_far + n / 2 <= left:
                drawn.add(i)
            so_far += n
        assert {i for i, _ in ours if got[i]["copies"] > whole} == drawn
        assert all(got[i]["copies"] >= whole for i, _ in ours)


def test_crowded_steps_are_split(spark, monkeypatch):
    from pyspark.sql import functions as F

    from touchline.llm import select

    monkeypatch.setattr(select, "CROWD", 5)
    rng = random.Random(4)
    rows = [(i, f"g{i % 3}" if i % 3 else None, 0.5 + rng.random() / 10**4, rng.randrange(1, 9)) for i in range(900)]
    d = spark.createDataFrame(rows, "id long, g string, rank double, size long")
    limit = spark.createDataFrame([("g1", 700.0), ("g2", 1e6), (None, 0.0)], "g string, most double")
    for group, most in ((["g"], limit), ([], spark.createDataFrame([(1500.0,)], "most double"))):
        got = {r["id"] for r in select.first_until(d, group, "rank", "size", most, "most", ["id"], "yes").filter("yes").collect()}
        want = set()
        for g, top in (("g1", 700.0), ("g2", 1e6), (None, 0.0)) if group else ((0, 1500.0),):
            so_far = 0
            for i, _, _, n in sorted((r for r in rows if not group or r[1] == g), key=lambda r: (r[2], r[0])):
                if so_far + n / 2 <= top:
                    want.add(i)
                so_far += n
        assert got == want
    assert select.first_until(d.filter(F.lit(False)), [], "rank", "size", limit.limit(1), "most", ["id"], "yes").count() == 0


def test_hot_keys_join_as_others_do(spark, monkeypatch):
    from touchline.llm import select

    monkeypatch.setattr(select, "HOT", 3)
    rows = spark.createDataFrame([(i, 0 if i < 40 else i % 9 if i % 7 else None) for i in range(100)], "id long, k long")
    groups = rows.filter("k is not null").groupBy("k").agg({"id": "max", "*": "count"}).toDF("k", "n", "top")
    for how in ("inner", "left"):
        got = sorted((r["id"], r["top"]) for r in select.join_counted(rows, groups.filter("k <> 5"), "k", "n", 100, how).collect() if r["top"] is not None)
        assert got == sorted((r["id"], r["top"]) for r in rows.join(groups.filter("k <> 5"), "k").collect())
    assert select.join_counted(rows, groups.filter("k <> 5"), "k", "n", 100, "left").count() == 100
