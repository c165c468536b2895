"""Language identification by error-correcting output codes over character n-grams."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialize, mix64
from .select import join_group, unit_interval

#: Hashed n-gram features, and the lengths of the n-grams.
FEATURES = 4096
ORDERS = (1, 2, 3, 4)
#: Labelled documents that a language is learned from, at most; and all languages together, which are
#: feature rows of 8 KB on the driver (128 MB, and twice that while they are trained on). With more than
#: ROWS / PER_LANGUAGE languages each gets fewer, but FEWEST at least.
PER_LANGUAGE, ROWS, FEWEST = 400, 16_000, 4
#: Characters, and texts, that are turned into features at once.
CHARS, TEXTS = 400_000, 128
#: The best language's share of the score below which a document counts as ambiguous.
AMBIGUOUS = 0.6
#: A text is foreign if its decoding loss and its likeness to the nearest languages are both worse than in
#: all but these shares of the documents set aside in training, and of their beginnings, of its length;
#: never if its bits fit the codeword with this mean probability.
LOSS_ABOVE, LIKENESS_BELOW, SURE = 0.02, 0.05, 0.93
#: Texts of that length from which a limit is set, at least.
ENOUGH = 20
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """By code point: is it a letter?"""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def letters_of(text: str | None) -> np.ndarray:
    """Code points of the lower-case letters, with one space for whatever stands between them and at
    both ends; empty if there is no letter."""
    if not text:
        return np.zeros(0, np.uint32)
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    codes[~_letters()[codes]] = 32
    space = codes == 32
    codes = codes[~(space & np.concatenate(([False], space[:-1])))]
    return codes if len(codes) > 1 else codes[:0]


def features(texts: list[np.ndarray]) -> np.ndarray:
    """Texts x FEATURES: square roots of the shares of hashed n-grams, so each row has length 1."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if not sizes.sum():
        return out
    codes = np.concatenate(texts).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    gram = np.zeros(len(codes), np.uint64)
    total = np.zeros(out.size, np.int64)
    for n in range(1, max(ORDERS) + 1):
        gram = (gram[: len(codes) - n + 1] * np.uint64(0x100000001B3)) ^ codes[n - 1 :] if n > 1 else codes
        if n in ORDERS:
            whole = owner[: len(gram)] == owner[n - 1 :]
            at = owner[: len(gram)][whole] * FEATURES + (mix64(gram[whole] + np.uint64(n << 40)) % np.uint64(FEATURES)).astype(np.int64)
            total += np.bincount(at, minlength=out.size)
    out = total.reshape(out.shape).astype(np.float32)
    return np.sqrt(out / np.maximum(out.sum(axis=1, keepdims=True), 1))


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n x bits matrix of +1 and -1. Up to 5 languages: every way to split them in two. More: the
    random code of 12 log2(n) bits with the largest smallest distance between codewords, of 50 (of as
    many as look at 10 million pairs, where there are many languages; that distance is then a sample's)."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        return np.array([[1 if b >> i & 1 else -1 for b in range(1, 1 << n) if b & 1 and b != (1 << n) - 1] for i in range(n)], np.int8)
    rng, bits, best, most = np.random.default_rng(seed), int(np.ceil(12 * np.log2(n))), None, -1
    for _ in range(50 if n <= 600 else 5):
        code = rng.choice(np.array([-1, 1], np.int8), size=(n, bits))
        some = code[rng.choice(n, min(n, 600), replace=False)]
        near = some.astype(np.int32) @ code.T.astype(np.int32)  # bits less twice the distance
        apart = int(bits - np.sort(near, axis=1)[:, -2].max()) // 2  # the largest is a word with itself
        balanced = np.abs(code.sum(axis=0)).max() < n
        if apart > most and balanced:
            best, most = code, apart
    return best


def _length(codes: list[np.ndarray]) -> np.ndarray:
    """Binary logarithms of the texts' letters."""
    return np.log2(np.maximum(1, np.fromiter(map(len, codes), np.int64, len(codes)))).astype(np.int64)


def _beginning(codes: np.ndarray) -> np.ndarray:
    """The first 8, 16, ... or 1024 letters of a text, by a hash of it."""
    return codes[: 8 << int(mix64(codes[:64].astype(np.uint64).sum(keepdims=True) + np.uint64(len(codes)))[0] % np.uint64(8))]


def _profiles(x: np.ndarray, label: np.ndarray, n: int) -> np.ndarray:
    return np.stack([(x[label == i] ** 2).mean(axis=0) if (label == i).any() else np.zeros(x.shape[1], np.float32) for i in range(n)])


def _limits(model: LanguageModel, x: np.ndarray, length: np.ndarray) -> np.ndarray:
    """By length: the loss and likeness that texts of learned languages, about that long, seldom pass."""
    limits = LanguageModel().limits
    if len(model.languages) > 1:  # a single language has no bits to decode, so nothing can be far from it
        loss = model.losses(x)
        likeness, loss = model.likeness(x, loss), loss.min(axis=1)
        for k in range(len(limits)):
            near = np.abs(length - k) <= 1
            if near.sum() >= ENOUGH:
                most = max(np.quantile(loss[near], 1 - LOSS_ABOVE), -np.log(SURE) * model.trust.sum())
                limits[k] = most, np.quantile(likeness[near], LIKENESS_BELOW)
    return limits


@dataclass
class LanguageModel:
    """One binary classifier for each bit of the codewords; `trust` is its accuracy beyond chance."""

    languages: list[str] = field(default_factory=list)
    code: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int8))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES, 1), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))
    trust: np.ndarray = field(default_factory=lambda: np.ones(1, np.float32))
    #: By language, the mean shares of the features; by binary logarithm of the letters, the largest loss and the least likeness.
    profiles: np.ndarray = field(default_factory=lambda: np.zeros((0, FEATURES), np.float32))
    limits: np.ndarray = field(default_factory=lambda: np.tile([np.inf, 0.0], (32, 1)))

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Texts x languages: decoding losses."""
        margin = x @ self.weights + self.bias
        one, other = np.logaddexp(0, -margin) * self.trust, np.logaddexp(0, margin) * self.trust
        return one @ (self.code > 0).T.astype(np.float32) + other @ (self.code < 0).T.astype(np.float32)

    def likeness(self, x: np.ndarray, loss: np.ndarray) -> np.ndarray:
        """Cosine of each text and its nearest language or, if larger, equal parts of its nearest two."""
        first = loss.argmin(axis=1)
        rest = loss.copy()
        rest[np.arange(len(x)), first] = np.inf
        one, both = self.profiles[first], (self.profiles[first] + self.profiles[rest.argmin(axis=1)]) / 2
        return np.maximum((x * np.sqrt(one)).sum(axis=1), (x * np.sqrt(both)).sum(axis=1))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score in [0, 1], whether the two nearest codewords are too close, and whether the
        text is in no learned language, of each text."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        ambiguous, foreign = np.ones(len(texts), bool), np.ones(len(texts), bool)
        at: list[int] = []
        codes: list[np.ndarray] = []

        def decide() -> None:
            x = features(codes)
            loss = self.losses(x)
            near = np.exp(loss.min(axis=1, keepdims=True) - loss)
            near /= near.sum(axis=1, keepdims=True)
            for i, k in zip(at, near.argmax(axis=1)):
                names[i] = self.languages[k]
            scores[at] = near.max(axis=1)
            ambiguous[at] = scores[at] < AMBIGUOUS
            worst, least = self.limits[_length(codes)].T
            foreign[at] = (loss.min(axis=1) > worst) & (self.likeness(x, loss) < least)
            at.clear()
            codes.clear()

        size = 0
        for i, text in enumerate(texts if self.languages else ()):
            found = letters_of(text)
            if len(found):
                at.append(i)
                codes.append(found)
                size += len(found)
                if size > CHARS or len(at) >= TEXTS:
                    decide()
                    size = 0
        if at:
            decide()
        return names, np.clip(scores, 0, 1), ambiguous, foreign


def _train_bits(x: np.ndarray, y: np.ndarray, epochs: int = 20, size: int = 128, penalty: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions of the columns of y (+1, -1) on x, by Adam on small batches, classes balanced."""
    rng = np.random.default_rng(3)
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    positive = (y > 0).mean(axis=0)
    balance = np.where(y > 0, 0.5 / np.maximum(positive, 1e-9), 0.5 / np.maximum(1 - positive, 1e-9)).astype(np.float32)
    state = [(np.zeros_like(v), np.zeros_like(v)) for v in (w, b)]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        rate = 0.2 * (1 - epoch / epochs)
        for at in range(0, len(x), size):
            rows = order[at : at + size]
            xs, ys = x[rows], y[rows]
            pull = -ys * balance[rows] / (1 + np.exp(np.clip(ys * (xs @ w + b), -50, 50))) / len(rows)
            step += 1
            for value, gradient, (m, s) in zip((w, b), (xs.T @ pull + penalty * w, pull.sum(axis=0)), state):
                m += 0.1 * (gradient - m)
                s += 0.01 * (gradient**2 - s)
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return w, b


def _drawn(known: DataFrame, per_language: int) -> DataFrame:
    """lang, text, aside: of each language, the rows with the smallest hashes of doc_id, per_language at
    most; every fifth, by another hash, is set aside.

    A language's rows are thinned by a limit on the hash, which follows from its number of rows, before
    any are put in order; so a language with a third of all rows is a few hundred rows in that step.
    Rows that share a doc_id and language share the place and are drawn together.
    """
    counts = known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n"))
    u = unit_interval(F.col("doc_id"))
    ids = join_group(known.select("doc_id", "lang"), counts.withColumnRenamed("lang", "of"), {"lang": "of"}, "doc_id")
    ids = ids.filter(u * F.col("n") < 2 * per_language + 50).select("doc_id", "lang").distinct()
    order = W.partitionBy("lang").orderBy(u, "doc_id")
    ids = materialize(ids.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_language).drop("rank"))
    # at most max(ROWS, FEWEST a language) ids, so this side may be broadcast
    drawn = known.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"])
    return drawn.select("lang", "text", (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0).alias("aside"))


def fit_language(docs: DataFrame, training: Column | None = None, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """A model from docs (doc_id, text, lang).

    Learns every value of lang among rows for which `training` holds, from at most per_language documents
    of each (fewer if there are so many languages that they would be more than ROWS together), those
    with the smallest hashes of doc_id. Rows with null lang, doc_id or text, or without a letter, teach
    nothing. The tasks turn texts into features; only those rows come to the driver.
    """
    known = docs.filter("lang is not null and text is not null and doc_id is not null")
    known = known.filter(training) if training is not None else known
    n_languages = known.agg(F.count_distinct("lang")).first()[0]
    drawn = _drawn(known, min(per_language, max(FEWEST, ROWS // max(1, n_languages))))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            aside = batch.column("aside").to_pylist()
            codes = [letters_of(t) for t in batch.column("text").to_pylist()]
            begun = [_beginning(c) for c in codes]
            packed = lambda c: features([c])[0].astype(np.float16).tobytes()
            arrays = [pa.array([packed(c) if len(c) else None for c in codes], pa.binary()), pa.array([packed(c) if a and len(c) else None for c, a in zip(begun, aside)], pa.binary())]
            lengths = [pa.array(_length(part), pa.int64()) for part in (codes, begun)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("aside"), *arrays, *lengths], names=["lang", "aside", "x", "begun", "x_length", "begun_length"])

    schema = "lang string, aside boolean, x binary, begun binary, x_length long, begun_length long"
    rows = drawn.mapInArrow(extract, schema).filter("x is not null").collect()
    rows.sort(key=lambda r: (r["lang"], r["x"]))
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return LanguageModel()
    place = {lang: i for i, lang in enumerate(languages)}
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32)
    label = np.array([place[r["lang"]] for r in rows])
    code = codewords(len(languages))
    y = code[label].astype(np.float32)
    checked = np.array([r["aside"] for r in rows])  # tell how far each bit can be trusted
    if checked.all() or not checked.any():
        checked = np.arange(len(x)) % 5 == 0
    learned = ~checked if (~checked).any() else np.ones(len(x), bool)
    w, b = _train_bits(x[learned], y[learned])
    right = ((x[checked] @ w + b) * y[checked] > 0).mean(axis=0)
    trust = np.maximum(2 * right - 1, 0.05).astype(np.float32)
    begun = [r for r in rows if r["begun"]]
    first = LanguageModel(languages, code, w, b, trust, _profiles(x[learned], label[learned], len(languages)))
    parts = [x[checked], *(np.frombuffer(r["begun"], np.float16).astype(np.float32)[None] for r in begun)]
    lengths = np.array([r["x_length"] for r, c in zip(rows, checked) if c] + [r["begun_length"] for r in begun])
    limits = _limits(first, np.concatenate(parts), lengths)
    w, b = _train_bits(x, y)
    return LanguageModel(languages, code, w, b, trust, _profiles(x, label, len(languages)), limits)


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of docs, and lang_pred string, lang_score double, lang_ambiguous boolean,
    lang_foreign boolean.

    lang_pred is the nearest learned language even of texts in none, which are lang_foreign. Null
    texts and texts without a letter are `und` with score 0, ambiguous and foreign; so is every text
    if the model knows no language. A model of one language finds no other foreign texts. Repeated rows are
    predicted each. Columns of docs with these names are replaced (the pipeline's stage sets them aside).
    """
    added = {"lang_pred": "string", "lang_score": "double", "lang_ambiguous": "boolean", "lang_foreign": "boolean"}
    docs = docs.drop(*added)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, ambiguous, foreign = held.value.predict(batch.column("text").to_pylist())
            new = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(ambiguous, pa.bool_()), pa.array(foreign, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *added])

    return docs.mapInArrow(predict, StructType([*docs.schema.fields, *StructType.fromDDL(", ".join(f"{n} {k}" for n, k in added.items())).fields]))
