"""The stages on a small corpus, against plain versions of what each decides."""

import random
import re

import pytest

import corpus_pipeline
from touchline.llm.language import letters_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM = "seven quick owls judge my vow beside nine old zinc frogs today"


def shingles(text):
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def unlinked(docs):
    """The documents that have the smallest id of what links lead to."""
    sets = {i: shingles(t) for i, t in docs.items()}
    root = {i: i for i in docs}
    for a in docs:
        for b in docs:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    return {i for i in docs if root[i] == i}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    words = ["".join(rng.choice(["ka", "to", "mi", "re", "lu", "so"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs, labels = {}, []
    for i in range(400):
        docs[i] = text(rng.randrange(20, 90))
        toxic = i % 9 == 0
        if toxic:
            docs[i] += " moron idiot" * 2
        labels.append((i, 1, int(toxic)))
    for i in range(400, 430):  # near copies
        w = docs[i - 300].split()
        docs[i] = " ".join([*w[:-1], "changed"]) if len(w) > 60 else docs[i - 300]
    docs |= {500: f"{docs[1]} {ITEM} {docs[2]}", 501: ITEM, 502: "1234 %%", 503: None, 504: ""}
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "kk", f"src{i % 3}", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    seen = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        if name == "mixture":
            break
        out.write.mode("overwrite").parquet(f"{tables}/{name}")
        docs = spark.read.parquet(f"{tables}/{name}")
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == columns
        if name == "toxicity":
            assert set(got) == {i for i, t in seen.items() if "moron" not in (t or "")}
        if name == "language":
            assert set(got) == {i for i, t in seen.items() if len(letters_of(t))}
        if name == "near_duplicates":
            assert set(got) == unlinked(seen)
        if name == "decontamination":
            assert set(got) == set(seen) - {501}
            assert ITEM not in got[500] and all(got[i] == seen[i] for i in got if i != 500)
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        seen = got
    rows = out.collect()
    sizes = {}
    for i, t in seen.items():
        sizes[f"src{i % 3}"] = sizes.get(f"src{i % 3}", 0) + len(WORD.findall(t))
    taken = {s: sum(r["taken"] for r in rows if r["source"] == s) for s in sizes}
    for k, s in enumerate(sorted(sizes)):
        assert abs(taken[s] - min(3 * sizes[s], sum(sizes.values()) * (k + 1) / 6)) < 100


def test_run_is_the_stages(spark, tables):
    rows = corpus_pipeline.run(spark, tables)
    assert rows.count() and {"doc_id", "copies", "taken"} <= set(rows.columns)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "decontamination", "mixture"]


def test_language_stage_drops_languages_without_labels(spark):
    rng = random.Random(21)
    spoken = {"aa": ["ka", "to", "mi", "re"], "bb": ["sch", "ung", "ber", "ei"], "cc": ["ção", "ñe", "ó", "lha"], None: ["αλ", "ος", "ει", "ντ"]}
    text = lambda lang, n: " ".join("".join(rng.choice(spoken[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    langs = list(spoken)
    rows = [(i, text(langs[i % 4], rng.randrange(5, 80)), langs[i % 4]) for i in range(800)]
    rows += [(i, f"{text('aa', 40)} {text('bb', 40)}", "aa") for i in range(800, 840)]  # mixed
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, d, "").collect()}
    unseen = {i for i, _, lang in rows if lang is None}
    assert len(kept & unseen) <= 0.05 * len(unseen)
    assert len(kept - unseen) >= 0.98 * (len(rows) - len(unseen))


def test_stages_with_clashing_columns_repeated_ids_and_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    text = lambda k: " ".join(f"w{k}{chr(97 + i % 26)}x{i}" for i in range(60))
    rows = [(i, text(i), "kk", f"s{i % 2}", 9, 0.9, "x", "y") for i in range(30)]
    rows += [(3, text(40), "kk", "s0", 9, None, "a", "b"), (4, text(4), "kk", "s0", 9, 0.1, "a", "b"), (50, "you idiot moron", "kk", "s1", 9, 0.0, "c", "d"), (None, text(60), None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, toxic_score double, lang_pred string, spans string"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    seen = sorted(((r[0], r[1], *r[5:]) for r in rows if r[0] != 50), key=str)
    # of the two rows with id 4 and one text, one stays
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.materialize(stage(spark, docs, folder))
            assert docs.columns == [f.split()[0] for f in schema.split(", ")]
            got = sorted(((r["doc_id"], r["text"], r["toxic_score"], r["lang_pred"], r["spans"]) for r in docs.collect()), key=str)
            if n and name in ("toxicity", "language"):
                assert got == seen
            elif n:
                assert len(got) == len(seen) - 1 and set(got) <= set(seen) and {r[:2] for r in got} == {r[:2] for r in seen}
        assert corpus_pipeline.mixture(spark, docs, folder).count() == (n > 0) * corpus_pipeline.mixture(spark, docs, folder).count()


def test_run_leaves_only_its_result(spark, tables):
    import os

    from touchline.llm.common import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, tables)
    assert out.count() and len(set(os.listdir(folder)) - before) == 1


def test_a_cluster_without_a_shared_folder_gets_a_clear_error():
    from touchline.llm.common import shared_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
