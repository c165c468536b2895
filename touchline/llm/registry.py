"""Queries opN_<name> of the subpackage and the pipeline, and the SQL that checks them."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.session import ship_package

from . import oracle
from .common import remainder, table
from .decontaminate import contamination_report
from .embeddings import near_duplicate_vectors
from .language import fit_language, predict_language
from .licences import fit_licences, scan_licences
from .lm import score_texts
from .minhash import near_duplicates
from .mixing import mix
from .negatives import hard_negatives
from .pages import extract_pages
from .quality import resample
from .sharding import shard_report
from .toxicity import fit_toxicity, score_toxicity
from .trie import shared_start_trie


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents: five-word shingles, similarity 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), ngram=5, percent=85).drop("class_size")


def op2_hpyp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of documents under the Pitman-Yor model of nine tenths of them."""
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), held_out=remainder("doc_id", 10) == 0)


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of documents that state a licence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licences(docs, fit_licences(docs))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in documents."""
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10).drop("coverage", "longest")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents resampled towards those labelled as good."""
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents mixed to source weights 1, 2, 3."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), weights=(1.0, 2.0, 3.0)).select(
        "doc_id", "size", "source_size", "target", "taken", "copies"
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of documents, learned from labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), training=remainder("doc_id", 5) != 0)
    return score_toxicity(docs, model).select(
        "doc_id",
        (remainder("doc_id", 5) == 0).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
        F.col("toxic_hits").alias("n_hits"),
    )


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings linked at cosine 0.95."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of pages."""
    return extract_pages(table(spark, sf_dir, "pages"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents, learned outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents")
    model = fit_language(docs.select("doc_id", "text", "lang"), training=remainder("doc_id", 4) != 2)
    return predict_language(docs.select("doc_id", "text"), model).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous")
    )


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of conversations that begin with turns of every hundredth one."""
    return shared_start_trie(table(spark, sf_dir, "conversations"), every=100, most=6)


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth embedding; every seventh has the next label."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", label.cast("long").alias("label")), F.col("vec_id") % 50 == 0)


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in 24 shards of near equal bytes, equal texts together."""
    return shard_report(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=24)


def _shipped(query):
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {f.__name__: _shipped(f) for f in (op1_minhash, op2_hpyp, op3_licences, op4_decontaminate, op5_quality, op6_mix_sources, op7_toxicity, op8_embeddings, op9_pages, op10_language, op11_trie, op12_negatives, op13_shards)}
ORACLE_SQL = oracle.ORACLE_SQL
