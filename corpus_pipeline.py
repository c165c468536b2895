"""From raw documents to a training mix: the operators of touchline.llm, one stage after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet and gives
what it reads back to the next. All stages but the last return the columns of documents, also those whose
names an operator adds itself. Rows that repeat a doc_id go through each stage by their own texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import discard, materialize, remainder, scratch, set_aside, table
from touchline.llm.decontaminate import remove_contamination
from touchline.llm.language import fit_language, predict_language
from touchline.llm.minhash import deduplicate
from touchline.llm.mixing import mix
from touchline.llm.toxicity import fit_toxicity, score_toxicity
from touchline.session import ship_package


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5. The lexicon is learned from the labelled documents
    of this stage's input; without any, known insults remain."""
    ship_package(spark)
    model = fit_toxicity(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), training=remainder("doc_id", 5) != 0)
    aside, back = set_aside(docs, ["toxic_score", "toxic_hits", "toxic_words"])
    return score_toxicity(aside, model).filter("toxic_score < 0.5").select(*aside.columns).withColumnsRenamed(back)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have letters of a language: those without any, and those in no language that the
    labelled documents are in (lang_foreign), go. Ambiguous documents stay: mixed languages are clean.
    Where no document has a language, nothing is known of any, and only those without letters go."""
    ship_package(spark)
    model = fit_language(docs.select("doc_id", "text", "lang"), training=remainder("doc_id", 4) != 2)
    if not model.languages:
        return docs.filter(F.regexp_like("text", F.lit(r"\p{L}")))
    aside, back = set_aside(docs, ["lang_pred", "lang_score", "lang_ambiguous", "lang_foreign"])
    return predict_language(aside, model).filter(~F.col("lang_foreign")).select(*aside.columns).withColumnsRenamed(back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id: five-word
    shingles, similarity 0.85."""
    ship_package(spark)
    return deduplicate(docs, ngram=5, percent=85)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages: windows of ten item words are cut out, and documents that
    are more than half hit go."""
    ship_package(spark)
    return remove_contamination(docs, table(spark, sf_dir, "benchmark"), window=10, max_coverage=0.5)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: doc_id, source, size, source_size, target, copies, taken of the documents that it takes."""
    ship_package(spark)
    return mix(docs.select("doc_id", "text", "source"), weights=(1.0, 2.0, 3.0)).filter("copies > 0")


STAGES = [
    ("toxicity", toxicity),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
]

#: Learned classifiers and hash-based sampling: no SQL says the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of documents. What a stage wrote on its way goes when its result is written, and that when
    the next stage has read it, so the shared folder holds two stages' results at most."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch(spark) as written:
            out = materialize(stage(spark, docs, sf_dir))
            written.remove(out._touchline_path)
        discard(spark, docs)
        docs = out
    return docs
