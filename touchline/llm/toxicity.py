"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text and set against its length."""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from itertools import accumulate
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialize

# Fixed values. Letters of other scripts and forms that look like Latin letters.
HOMOGLYPHS = str.maketrans({
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l", "ｏ": "o", "ⅰ": "i", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
    "­": "", "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "",
} | {chr(0xFF41 + i): chr(97 + i) for i in range(26)})

# Fixed values. Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}

# Fixed values. Insults known before any label is seen.
SEED_WORDS = (
    "asshole bastard clown dumbass disgusting fool idiot imbecile jerk loser moron pathetic scum stupid trash vermin worthless "
    "abschaum blödmann dummkopf idioten trottel versager widerlich "
    "abruti connard crétin débile minable pourriture salaud "
    "asqueroso basura cabrón estúpido idiota imbécil inútil patético"
).split()

# Fixed values. Phrases in which such a word is no insult.
EXCEPTION_PHRASES = (
    "clown fish", "clown nose", "class clown", "pathetic fallacy", "pond scum", "scum layer", "trash can", "trash bin",
    "trash bag", "trash collection", "trash truck", "stupid question", "fool proof", "jerk chicken", "bolsa de basura", "camión de basura",
)

_HOMOGLYPH = re.compile("[" + "".join(map(chr, HOMOGLYPHS)) + "]")
_SUBSTITUTE = re.compile(r"(?<=[^\W\d_])[0134578](?=\w)|[0134578@$](?=[^\W\d_])|(?<=[^\W\d_])[!|](?=[^\W\d_])|(?<=[^\W\d_])[0134578]")
#: At least four letters or digits, each alone between signs of one kind.
_APART = re.compile(r"(?<![^\W_])[^\W_]([ .\-_*~/|])[^\W_](?:\1[^\W_]){2,}(?![.\-_*~/|]?[^\W_])")
_DRAWN_OUT = re.compile(r"([^\W\d_])\1{2,}")
_DOUBLED = re.compile(r"([^\W\d_])\1")
_OTHER = re.compile(r"[\W_]+")
_MARK = re.compile("[\u0300-\u036f\u0483-\u0489\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe00-\ufe0f\ufe20-\ufe2f]+")

#: Labelled rows that the lexicon and the curve are learned from, at most, of either class.
SAMPLE = 3000
#: Lengths of word beginnings that may become entries.
STEM = range(3, 11)
#: Stems, or stems and what stands around them, that a task holds before it hands them on.
HELD = 100_000
#: A document may be this many times likelier toxic by each known seed word, before labels speak.
SEED_WEIGHT = math.log(30)


def _together(found: re.Match) -> str:
    """Letters set apart (i.d.i.o.t) as one word; digits alone stay as they are."""
    own = found.group()
    return own[::2] if any(c.isalpha() for c in own) else own


def single(stem: str) -> str:
    """The stem as fold leaves it where its doubled letters are drawn out further."""
    return _DOUBLED.sub(r"\1", stem)


def fold(text: str | None) -> str:
    """' word word ' in lower case without accents, look-alikes and substitutes as the letters they stand for, letters
    set apart joined (four at least; a word of one letter right before them, set apart alike, joins too), three or more of
    one letter as one."""
    if not text:
        return " "
    low = text.lower()
    if not low.isascii():
        low = _MARK.sub("", unicodedata.normalize("NFKD", low)).lower()
        if _HOMOGLYPH.search(low):
            low = low.translate(HOMOGLYPHS)
    low = _APART.sub(_together, low)
    low = _SUBSTITUTE.sub(lambda m: SUBSTITUTES[m.group()], low)
    low = _DRAWN_OUT.sub(r"\1", low)
    return f" {_OTHER.sub(' ', low).strip()} "


def uncovered(hits: list[tuple[int, int, float]], covers: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
    """The hits (begin, end, ...) that lie within none of covers (begin, end)."""
    if not covers:
        return hits
    begins = sorted(covers)
    reach = list(accumulate((end for _, end in begins), max))
    starts = [begin for begin, _ in begins]
    return [h for h in hits if (at := bisect_right(starts, h[0])) == 0 or reach[at - 1] < h[1]]


@dataclass
class ToxicityModel:
    """Entries are word beginnings with weights; the score is 1 / (1 + exp(-(bias + slope * x))) of
    x = ln(1 + 100 * weight of hits / words)."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTION_PHRASES
    bias: float = -2.0
    slope: float = 2.0

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for phrase in self.exceptions:
            found.add_word(f" {fold(phrase).strip()} ", (len(fold(phrase)), None))
        for stem, weight in self.entries.items():
            found.add_word(f" {stem}", (len(stem) + 1, weight))
        for stem, weight in self.entries.items():
            drawn = single(stem)
            # "asshole" drawn out is "ashole"; a beginning of the stem itself would count its word twice
            if not stem.startswith(drawn) and not any(drawn.startswith(e) for e in self.entries) and f" {drawn}" not in found:
                found.add_word(f" {drawn}", (len(drawn) + 1, weight))
        found.make_automaton()
        return found

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"}

    def density(self, text: str | None) -> tuple[int, float, int]:
        """Hits that no exception phrase covers, their weight per word, words."""
        if "_automaton" not in self.__dict__:
            self._automaton = self.automaton()
        folded = fold(text)
        words = len(folded.split())
        if not words or not len(self._automaton):
            return 0, 0.0, words
        hits, covered = [], []
        for end, (size, weight) in self._automaton.iter(folded):
            if weight is None:
                covered.append((end - size + 1, end))
            else:
                hits.append((end - size + 1, end, weight))
        hits = uncovered(hits, covered)
        return len(hits), sum(h[2] for h in hits) / words, words

    def feature(self, density: float) -> float:
        return math.log1p(100 * density)

    def score(self, density: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.bias + self.slope * self.feature(density)))))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """All columns of docs, and toxic_score double, toxic_hits int, toxic_words int.

    Null and empty texts have no hits; their score is that of a text without any. Repeated rows are
    scored each. Columns of docs with these names are replaced (the pipeline's stage sets them aside).
    """
    added = {"toxic_score": "double", "toxic_hits": "int", "toxic_words": "int"}
    docs = docs.drop(*added)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            rows = [m.density(t) for t in batch.column("text").to_pylist()]
            new = [pa.array([m.score(d) for _, d, _ in rows], pa.float64()), pa.array([h for h, _, _ in rows], pa.int32()), pa.array([w for _, _, w in rows], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *added])

    schema = StructType([*docs.schema.fields, *StructType.fromDDL(", ".join(f"{n} {k}" for n, k in added.items())).fields])
    return docs.mapInArrow(score, schema)


def _stems(words: set[str]) -> set[str]:
    return {w[:n] for w in words for n in STEM if n <= len(w)}


def _stem_counts(sample: DataFrame) -> DataFrame:
    """stem, toxic, clean: documents of the sample (text, label) of either class with a word that begins so."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter[str], Counter[str]] = Counter(), Counter()

        def done() -> Iterator[pa.RecordBatch]:
            for label, found in enumerate(counts):
                n, none = pa.array(list(found.values()), pa.int64()), pa.array([0] * len(found), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *((n, none) if label else (none, n))], names=["stem", "toxic", "clean"])
                found.clear()

        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                counts[label].update(_stems(set(fold(text).split())))
                if len(counts[label]) > HELD:
                    yield from done()
        yield from done()

    return sample.select("text", "label").mapInArrow(count, "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _context_counts(sample: DataFrame, among: set[str]) -> DataFrame:
    """stem, n: different pairs of words around a word that begins so."""
    held = sample.sparkSession.sparkContext.broadcast(among)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, str]] = set()

        def done() -> pa.RecordBatch:
            rows = list(seen)
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["stem", "around"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                words = ["", *fold(text).split(), ""]
                for i, w in enumerate(words[1:-1], 1):
                    seen.update((w[:n], f"{words[i - 1]} {words[i + 1]}") for n in STEM if n <= len(w) and w[:n] in held.value)
                    if len(seen) > HELD:
                        yield done()
        yield done()

    return sample.select("text").mapInArrow(contexts, "stem string, around string").groupBy("stem").agg(F.count_distinct("around").alias("n"))


def _chosen(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, longest: bool = True, tried: int = 0) -> dict[str, float]:
    """Stems that mark toxic documents beyond chance (of `tried` stems, or those given), with their
    weights (log of the ratio of rates); with `longest`, one of those that begin alike."""

    def surprise(a: int, b: int) -> float:
        """Likelihood ratio statistic of a of n_toxic against b of n_clean."""
        p = (a + b) / (n_toxic + n_clean)
        terms = ((a, n_toxic * p), (n_toxic - a, n_toxic * (1 - p)), (b, n_clean * p), (n_clean - b, n_clean * (1 - p)))
        return 2 * sum(o * math.log(o / e) for o, e in terms if o > 0 and e > 0)

    seeds = {fold(w).strip()[: STEM[-1]] for w in SEED_WORDS}
    limit = 2 * math.log(1e4 * max(1, tried, len(toxic)))
    weights = {}
    for stem in set(toxic) | seeds:
        a, b = toxic.get(stem, 0), clean.get(stem, 0)
        weight = math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1))
        if stem in seeds and b <= 0.02 * n_clean and a * n_clean >= 3 * b * n_toxic:
            weights[stem] = max(weight, SEED_WEIGHT)
        elif weight > math.log(10) and len(stem) > 3 and surprise(a, b) > limit:
            weights[stem] = weight
    if not longest:
        return weights
    # the longest stem that still has (nearly) all documents of a shorter one, and no longer ones that add nothing
    kept = {}
    for stem in sorted(weights, key=len):
        longer = [s for s in weights if len(s) > len(stem) and s.startswith(stem)]
        same = [s for s in longer if toxic.get(s, 0) >= 0.9 * toxic.get(stem, 0)]
        if (stem in seeds or not same) and not any(stem.startswith(k) and weights[k] > weights[stem] - 0.7 for k in kept):
            kept[stem] = weights[stem]
    return kept


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """bias and slope of a logistic curve, by Newton's method with a small penalty on the slope."""
    design = np.stack([np.ones_like(x), x], axis=1)
    beta = np.array([-2.0, 2.0])
    penalty = np.diag([1e-3, 1e-2 * max(1.0, weight.sum() / 1000)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - penalty @ (beta - np.array([0.0, 2.0]))
        step = np.linalg.solve(design.T @ (design * (weight * p * (1 - p) + 1e-9)[:, None]) + penalty, gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(max(beta[1], 0.1))


def fit_toxicity(docs: DataFrame, labels: DataFrame, training: Column | None = None, sample: int = SAMPLE) -> ToxicityModel:
    """A model from docs (doc_id, text) and labels (doc_id, toxic 0 or 1).

    Learns from at most `sample` labelled documents of either class, those with the smallest hashes
    of doc_id among rows for which `training` (a condition on doc_id) holds. Where a doc_id has
    several labels, 1 wins; null labels and ids are passed over; rows that repeat a doc_id count each.
    Without labels the seed words remain. Stems are counted and compared in Spark; those that are ten
    times likelier in toxic documents of the sample, and the sample's densities, come to the driver.
    """
    known = labels.filter("doc_id is not null and toxic is not null")
    known = (known.filter(training) if training is not None else known).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    totals = {int(r["label"] > 0): r["n"] for r in known.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = docs.select(F.col("doc_id"), "text")
    picked = [known.filter(side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for side in (F.col("label") > 0, F.col("label") <= 0)]
    # at most 2 * sample ids, so this side may be broadcast
    drawn = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").select("text", (F.col("label") > 0).cast("int").alias("label"))
    drawn = materialize(drawn)
    n_toxic, n_clean = (drawn.filter(F.col("label") == k).count() for k in (1, 0))
    seeds = {fold(w).strip()[: STEM[-1]] for w in SEED_WORDS}
    counted = materialize(_stem_counts(drawn).filter((F.col("toxic") >= 3) | F.col("stem").isin(*seeds)))
    tried = counted.filter("toxic >= 3").count()
    # those that may be chosen: ten times likelier in toxic documents, or seeds
    likelier = (F.col("toxic") + 0.5) / (n_toxic + 1) > 9.9 * (F.col("clean") + 0.5) / (n_clean + 1)
    rows = counted.filter(likelier | F.col("stem").isin(*seeds)).collect()
    toxic, clean = ({r["stem"]: r[side] for r in rows} for side in ("toxic", "clean"))
    # copies of one toxic document make all its words frequent: what counts is in how many places a stem stands
    first = _chosen(toxic, clean, n_toxic, n_clean, longest=False, tried=tried)
    places = {r["stem"]: r["n"] for r in _context_counts(drawn.filter("label = 1"), set(first)).collect()}
    toxic = {s: min(n, places.get(s, 0)) for s, n in toxic.items() if s in first}
    model = ToxicityModel(_chosen(toxic, clean, n_toxic, n_clean, tried=tried))
    if n_toxic and n_clean:
        held = docs.sparkSession.sparkContext.broadcast(model)

        def densities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([held.value.density(t)[1] for t in batch.column("text").to_pylist()], pa.float64()), batch.column("label")], names=["density", "label"])

        seen = drawn.mapInArrow(densities, "density double, label int").toPandas()
        y = seen["label"].to_numpy(float)
        share = {k: totals.get(k, 0) / n for k, n in ((1, n_toxic), (0, n_clean))}
        weight = np.where(y > 0, share[1], share[0]) * len(y) / max(1, sum(totals.values()))
        model.bias, model.slope = _curve(np.log1p(100 * seen["density"].to_numpy(float)), y, weight)
    return model
