import random

from pyspark.sql import functions as F

from touchline.llm.licences import OTHER_SENTENCES, TEMPLATES, _hashes, _pair_hashes, _windows, fit_licences, scan_licences


def test_finds_families_and_leaves_the_rest(spark):
    rng = random.Random(4)
    filler = lambda n: " ".join("".join(rng.choice(["th", "an", "er", "ing", "ou"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows, want = [], {}
    for i, (family, text) in enumerate((f, t) for f in TEMPLATES for t in TEMPLATES[f]):
        rows.append((i, f"{filler(30)}\n\n{text.upper() if i % 3 else text}\n\n{filler(40)}.", "s"))
        want[i] = family
    rows += [(1000 + i, f"{filler(20)}\n{s}\n{filler(9)}", "s") for i, s in enumerate(OTHER_SENTENCES)]
    rows += [(2000 + i, filler(80), "s") for i in range(60)] + [(3000, None, "s"), (3001, "", "s"), (3002, " \n\n ", "s")]
    rows += [(3003, f"{filler(3000)} Licensed under the Apache License, Version 2.0. {filler(3000)}", "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, family string")
    model = fit_licences(d)
    got = scan_licences(d, model).filter("confirmed").collect()
    families = {}
    for r in got:
        families.setdefault(r["doc_id"], set()).add(r["family"])
    right = sum(want[i] in families.get(i, ()) for i in want)
    assert right >= 0.95 * len(want), {i: (want[i], families.get(i)) for i in want if want[i] not in families.get(i, ())}
    assert all(r["paragraph"] == 1 for r in got if r["doc_id"] in want)
    assert not [k for k in families if 1000 <= k < 3003]
    assert scan_licences(d.limit(0), model).count() == 0


def test_the_plan_is_native(spark):
    d = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    found = scan_licences(d, fit_licences(d))
    text = found._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("Python", "Pandas", "InArrow") if w in text]
    assert found.filter("confirmed").count() == 1


# notices whose wording is in no template, by family
UNSEEN = [
    ("mpl", "MPL-2.0"), ("apache-2.0", "Apache-2.0"), ("agpl", "AGPL-3.0"), ("cc-by", "CC-BY-4.0"), ("lgpl", "LGPLv2.1 or later"),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED. IN NO EVENT SHALL THE COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY"),
    ("public-domain", "Anyone is free to copy, modify, publish, use this software for any purpose and by any means."),
    ("agpl", "Distributed under the AGPLv3."), ("lgpl", "Distributed under the terms of LGPLv2.1."), ("bsd", "The code is BSD-3-Clause"), ("cc-by-sa", "Available under CC-BY-SA 4.0"),
    ("mpl", "We release it under the MPL 2.0."), ("mit", "Distributed under MIT license terms."), ("gpl", "You may use it under the GPL v3 or any later version."),
    ("apache-2.0", "Sources fall under\nthe Apache License,\nVersion 2.0, as all our work does."),
]


def test_finds_notices_in_other_words(spark):
    rng = random.Random(5)
    filler = lambda n: " ".join("".join(rng.choice(["th", "an", "er", "ing", "ou"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, f"{filler(30)}\n\n{text}\n\n{filler(20)}") for i, (_, text) in enumerate(UNSEEN)] + [(100 + i, f"{filler(50)}\n{text}\n{filler(50)}") for i, (_, text) in enumerate(UNSEEN)]
    plain = [(1000 + i, "\n\n".join(filler(rng.randrange(1, 90)) for _ in range(5))) for i in range(80)]
    d = spark.createDataFrame(rows + plain + rows[:3], "doc_id long, text string")
    got = scan_licences(d, fit_licences(d)).filter("confirmed").collect()
    found = {(r["doc_id"], r["family"]) for r in got}
    missed = [(i, f, t) for base in (0, 100) for i, (f, t) in enumerate(UNSEEN, base) if (i, f) not in found]
    assert len(missed) <= 2 and not [m for m in missed if m[0] < 7], missed
    assert not [r for r in got if r["doc_id"] >= 1000] and len({(r["doc_id"], r["paragraph"], r["family"]) for r in got}) == len(got)


def test_without_documents(spark):
    none = spark.createDataFrame([(1, None)], "doc_id long, text string")
    model = fit_licences(none)
    assert scan_licences(none, model).count() == 0
    one = spark.createDataFrame([(None, "Released under the MIT License.")], "doc_id long, text string")
    assert [r["family"] for r in scan_licences(one, model).collect()] == ["mit"]


def test_texts_that_share_an_id_and_what_no_notice_confirms(spark):
    rows = [(1, "Released under the MIT License."), (1, "Plain words here.\n\nThe SOFTWARE license text of no family at all, for any purpose."), (1, "Licensed under the Apache License, Version 2.0."), (1, "Released under the MIT License.")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = fit_licences(d)
    got = scan_licences(d, model).collect()
    assert sorted((r["doc_id"], r["paragraph"], r["family"]) for r in got) == [(1, 0, "apache-2.0"), (1, 0, "mit")] and len({r["text_hash"] for r in got}) == 2
    every = scan_licences(d, model, unconfirmed=True).collect()
    assert {tuple(r) for r in got} <= {tuple(r) for r in every} and all(r["confirmed"] == (r["similarity"] >= 0.6) for r in every)


def test_windows_pass_on_the_numbers_that_training_learns(spark):
    words = [f"w{i}x" for i in range(50)]
    d = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    found = {r["word"]: r for r in _windows(d).collect()}
    assert sorted(found) == [1, 21] and found[21]["words"] == words[20:]
    for first, row in found.items():
        hashes = spark.createDataFrame([(row["words"],)], "words array<string>").select(_hashes(F.col("words")).alias("h"))
        learned = hashes.select(F.concat("h", _pair_hashes(F.col("h"))).alias("grams")).first()["grams"]
        assert row["grams"] == learned and len(set(learned)) == 2 * len(row["words"]) - 1
