import random

import numpy as np

from touchline.llm.language import LanguageModel, codewords, features, fit_language, letters_of, predict_language

SYLLABLES = {"aa": "ka to mi re", "bb": "sch ung ber ei", "cc": "ção ñe ó lha", "dd": "th ing er wh", "ee": "пре ро на ть", "ff": "αλ ος ει ντ", "gg": "zs gy ok et"}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_codewords_are_apart():
    assert codewords(1).shape == (1, 1) and codewords(4).shape == (4, 7)
    for n in (2, 3, 4, 5, 9, 40):
        code = codewords(n)
        apart = (code[:, None, :] != code[None, :, :]).sum(axis=2)[np.triu_indices(n, 1)]
        assert apart.min() >= max(1, code.shape[1] // 4)


def test_letters_and_features():
    assert "".join(map(chr, letters_of("Ab1-É\n\nx "))) == " ab é x "
    assert not len(letters_of("12 !! ")) and not len(letters_of(None)) and not len(letters_of(""))
    x = features([letters_of("abc abc"), letters_of(None), letters_of("zzz")])
    assert np.allclose((x**2).sum(axis=1), [1, 0, 1])
    assert np.allclose(features([letters_of("zzz")])[0], x[2])  # texts do not run into each other


def test_learns_held_out_languages(spark):
    rng = random.Random(9)
    for langs in (list(SYLLABLES)[:4], list(SYLLABLES)):
        rows = []
        for i in range(700):
            lang = rng.choice(langs)
            rows.append((i, text(rng, lang, rng.randrange(4, 60)).upper() if i % 5 == 0 else text(rng, lang, 20), lang, "s"))
        rows += [(2000, None, "aa", "s"), (2001, "", None, "s"), (2002, "1234 %%%", "bb", "s"), (2003, "ka to " * 40_000, None, "s"), (None, "ka", "aa", "s")]
        d = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_score string")
        model = fit_language(d, training=d["doc_id"] % 4 != 2, per_language=60)
        got = {r["doc_id"]: r for r in predict_language(d.select("doc_id", "text", "lang_score"), model).collect()}
        held = [r for r in rows if r[0] is not None and r[0] < 700 and r[0] % 4 == 2]
        assert sum(got[r[0]]["lang_pred"] == r[2] for r in held) > 0.97 * len(held)
        assert got[2000]["lang_pred"] == got[2001]["lang_pred"] == got[2002]["lang_pred"] == "und" and got[2003]["lang_pred"] == "aa"
        assert all(0 <= r["lang_score"] <= 1 for r in got.values())


def test_no_languages(spark):
    d = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = fit_language(d)
    assert model.languages == [] and predict_language(d, model).first()["lang_pred"] == "und"
    assert predict_language(d.limit(0), LanguageModel()).count() == 0
    one = fit_language(spark.createDataFrame([(i, "abc def", "xx") for i in range(12)], "doc_id long, text string, lang string"))
    assert one.predict(["hello", None])[0] == ["xx", "und"]


def test_losses_by_brute_force():
    rng = np.random.default_rng(2)
    code = codewords(9)
    m = LanguageModel(list("abcdefghi"), code, rng.normal(size=(4096, code.shape[1])).astype(np.float32), rng.normal(size=code.shape[1]).astype(np.float32), rng.random(code.shape[1]).astype(np.float32))
    x = features([letters_of(t) for t in ("one text", "another", "zzz")])
    margin = x @ m.weights + m.bias
    want = [[sum(m.trust[b] * np.log1p(np.exp(-margin[i, b] * code[k, b])) for b in range(code.shape[1])) for k in range(9)] for i in range(3)]
    assert np.allclose(m.losses(x), want, rtol=1e-4)


def test_more_languages_than_two_hundred(spark):
    rng = random.Random(3)
    letters = [chr(0x4E00 + i) for i in range(400)]
    spoken = {f"l{k:03}": rng.sample(letters, 12) for k in range(230)}
    rows = [(i, " ".join("".join(rng.choice(spoken[lang]) for _ in range(3)) for _ in range(20)), lang) for i, lang in enumerate(list(spoken) * 8)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_language(d, training=d["doc_id"] % 8 != 7)
    assert model.languages == sorted(spoken)
    held = [r for r in predict_language(d, model).filter("doc_id % 8 = 7").collect()]
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.9 * len(held)


def test_drawn_are_the_smallest_hashes(spark):
    """Whatever a language's share of the rows; rows that share a doc_id are drawn together."""
    from pyspark.sql import functions as F

    from touchline.llm.language import _drawn

    rows = [(i, f"t{i}", "big" if i % 50 else "small") for i in range(5000)] + [(1, "again", "big"), (1, "again", "big")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [(r["lang"], r["text"]) for r in _drawn(d, 30).collect()]
    order = sorted((r["h"] % 2**64, r["lang"], r["doc_id"]) for r in d.select(F.xxhash64("doc_id").alias("h"), "lang", "doc_id").distinct().collect())
    want = {lang: [i for _, g, i in order if g == lang][:30] for lang in ("big", "small")}
    assert sorted(got) == sorted((g, t) for i, t, g in rows if i in want[g])
