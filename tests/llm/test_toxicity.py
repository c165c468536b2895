import random

from touchline.llm.toxicity import ToxicityModel, fit_toxicity, fold, score_toxicity


def test_fold():
    assert fold("Yοu 1d10t! $TUPID​ m0r0n, l0ser5 ｃlown") == " you idiot stupid moron losers clown "
    assert fold("DE!! UNE$$$ 1999 covid") == " de une 1999 covid "
    assert fold(None) == fold("") == fold(" - ").replace("  ", " ") == " " or fold(" - ") == "  "


def test_exceptions_and_length():
    m = ToxicityModel({"clown": 4.0, "trash": 4.0})
    assert m.density("a clown fish near the trash can")[0] == 0
    assert m.density("that clown and his TRASH talk")[:2] == (2, 8 / 6)
    assert m.density(None) == (0, 0.0, 0) and m.score(0.0) < 0.5
    assert m.density("you clown " + "word " * 98)[1] < m.density("you clown")[1]
    assert m.density("aclown is none")[0] == 0


def test_letters_set_apart_and_drawn_out():
    assert fold("you i.d.i.o.t, I D I O T! 1-d-1-0-t") == " you idiot idiot idiot "
    assert fold("idiiiot stupiiiid 1.2.3.4 a b c x.y.z") == " idiot stupid 1 2 3 4 a b c x y z "
    m = ToxicityModel({"asshole": 4.0, "troll": 3.0, "idiot": 2.0})
    assert m.density("assshole ASSHOLE ashole")[:2] == (3, 4.0)
    assert m.density("troll trotll pass ash")[:2] == (1, 3 / 4)
    assert m.density("i_d_i_o_t idioooot i-d-i-o-t")[:2] == (3, 2.0)
    text = "a " * 300_000 + "aaaa" * 100_000
    assert len(fold(text).split()) <= 2


def documents(rng, n, first=0):
    vocabulary = [a + b + c for a in ("ba", "ri", "to", "mel") for b in ("na", "sk", "or") for c in ("e", "ist", "um", "a")]
    rows, labels = [], []
    for i in range(first, first + n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 200))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(max(2, len(words) // 40)):
                words.insert(rng.randrange(len(words)), rng.choice(["grunzkopf", "Grunzköpfe", "grunzerei", "moron", "m0r0n"]))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_learns_stems_and_generalises(spark):
    rng = random.Random(11)
    rows, labels = documents(rng, 900)
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic_score string")
    known = spark.createDataFrame(labels[:600] + [(None, 1), (5000, None)] + labels[:3], "doc_id long, toxic int")
    model = fit_toxicity(d, known, sample=200)
    assert any("grunzkopf".startswith(k) for k in model.entries)
    got = {r["doc_id"]: r["toxic_score"] for r in score_toxicity(d, model).collect()}
    assert all((got[i] >= 0.5) == bool(t) for i, t in labels[600:])
    assert all(0 <= s <= 1 for s in got.values())


def test_without_labels_and_empty(spark):
    d = spark.createDataFrame([(1, "you idiot moron"), (2, "good day"), (3, None), (4, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = fit_toxicity(d, none)
    got = {r["doc_id"]: r["toxic_score"] for r in score_toxicity(d, model).collect()}
    assert got[1] > 0.5 > got[2] == got[3] == got[4]
    assert score_toxicity(d.limit(0), model).count() == 0


def test_accents_and_marks_are_folded():
    assert fold("ïdiot i\u0308diot MÒRON dummkopf Trottèl ﬁlth") == " idiot idiot moron dummkopf trottel filth "
    assert fold("cabrón blödmann") == " cabron blodmann "


def test_cover_by_brute_force():
    from touchline.llm.toxicity import uncovered

    rng = random.Random(3)
    for _ in range(300):
        spans = lambda n: [(a, a + rng.randrange(1, 9)) for a in (rng.randrange(40) for _ in range(rng.randrange(n)))]
        hits, covers = [(a, b, 1.0) for a, b in spans(12)], spans(6)
        assert uncovered(hits, covers) == [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b in covers)]


def test_density_by_brute_force():
    """Hits of word beginnings and exceptions, looked up word by word."""
    rng = random.Random(4)
    m = ToxicityModel({"idiot": 3.0, "scum": 2.0, "moro": 1.5})
    words = ["idiot", "Idiots", "scum", "pond", "scum layer", "moron", "1d10t", "calm", "idi", "the", "trash can", "ïdiot"]
    for _ in range(200):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))
        folded = fold(text).split()
        weight = 0.0
        for i, w in enumerate(folded):
            kept = [v for k, v in m.entries.items() if w.startswith(k)]
            pond = w == "scum" and (folded[i - 1 : i] == ["pond"] or folded[i + 1 : i + 2] == ["layer"])
            weight += 0 if pond else sum(kept)
        assert abs(m.density(text)[1] - (weight / len(folded) if folded else 0)) < 1e-12


def test_very_long_text_takes_linear_time(spark):
    import time

    m = ToxicityModel({"idiot": 3.0})
    begun = time.time()
    assert m.density("trash can idiot " * 80_000)[0] == 80_000
    assert time.time() - begun < 5
    d = spark.createDataFrame([(1, "calm words " * 200_000, 1), (1, "calm words " * 200_000, 1), (2, "you idiot", 2)], "doc_id long, text string, toxic_hits int")
    got = score_toxicity(d, m).collect()
    assert sorted(r["toxic_hits"] for r in got) == [0, 0, 1] and len({r["toxic_score"] for r in got if r["doc_id"] == 1}) == 1
