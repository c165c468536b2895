"""Language-model scoring: a hierarchical Pitman-Yor model of word pairs.

Each word is a context and has a restaurant, which seats the training tokens that follow it. All context
restaurants share one parent, whose customers are their tables; its parent is uniform over the V
training words and the unknown word. The end of a text is a token, and the context of a first word.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, note_written, shared_dir, shuffle_partitions
from .hpyp import FEW, discount_of, draw_tables, hashed_gamma, hashed_uniform

#: Bytes of text that are counted together.
CHUNK = 3_000_000
#: Tokens for each bucket of words or pairs, so that a bucket's memory is bounded.
BUCKET = 1_000_000
#: Stands for the end of a text among the words, none of which holds it.
END = b"\n"
#: Chains, Gibbs sweeps of each, and sweeps at the end whose seatings are kept: predictive probabilities
#: are averaged over CHAINS * KEPT seatings.
CHAINS, SWEEPS, KEPT = 2, 3, 2
THETA = 1.0

#: Pairs that a worker remembers the tables of, from one chunk to the next: those of most customers.
REMEMBERED = 1 << 19

CHUNKS = "chunk long, doc_ids array<long>, held array<boolean>, sizes array<int>, words binary, n_words long, tokens binary, counts binary, pairs binary, pair_counts binary, trained long"
ASKED = "bucket int, chunk long, at binary, names binary, counts binary"
ANSWERED = "chunk long, bucket int, a binary, b binary, c binary, d binary, named long, types long, ones long, twos long"
SEATED = "chunk long, bucket int, a binary, b binary, c binary, customers array<long>, tables array<long>, masses array<long>"
#: Masses of words are whole multiples of 1 / MASS, so sums of them don't depend on their order.
MASS = 1 << 20
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


_TO_BYTES, _FROM_BYTES = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers, as many bytes as the largest needs, byte by byte and compressed."""
    x = np.asarray(x, np.int64)
    width = 8 if not len(x) or x.min() < 0 else max(1, -(-int(x.max()).bit_length() // 8))
    planes = np.empty((width, len(x)), np.uint8)
    for k in range(width):
        planes[k] = (x >> (8 * k)) & 255
    return bytes([width]) + _TO_BYTES.compress(planes)


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(_FROM_BYTES.decompress(memoryview(blob)[1:]), np.uint8).reshape(blob[0], -1)
    x = planes[0].astype(np.int64)
    for k in range(1, len(planes)):
        x |= planes[k].astype(np.int64) << (8 * k)
    return x


def _pack_words(words: list[bytes]) -> bytes:
    return _TO_BYTES.compress(b" ".join(words))


def _unpack_words(blob: bytes) -> list[bytes]:
    return _FROM_BYTES.decompress(blob).split(b" ")


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after another, and how many each text has (null: none)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    ends -= ends[0]
    there = pc.greater(pc.binary_length(words), 0)  # white space at either end leaves empty words
    so_far = np.concatenate(([0], np.cumsum(there.to_numpy(zero_copy_only=False))))
    return words.filter(there), np.diff(so_far[ends])


_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "array<int>": pa.list_(pa.int32())}


def _record(fields: str, rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in fields.split(", ")))
    columns = zip(*rows) if rows else ([] for _ in names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _TYPES[k]) for c, k in zip(columns, kinds)], names=list(names))


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Files that executions shuffle inside are removed as each ends, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _by_chunk(df: DataFrame, buckets: int) -> DataFrame:
    """Write df in the shared folder bucketed by chunk, so joins by chunk need not deal it out again."""
    spark, name = df.sparkSession, f"touchline_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    with _shuffles_freed(spark):  # what is written is read from here on
        df.write.bucketBy(buckets, "chunk").option("path", path).saveAsTable(name)
    note_written(path)
    written = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; the files stay
    return written


def _joined(words: pa.Array) -> list[bytes]:
    """All words as one, blanks between them (none: nothing)."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.large_binary()))
    return pc.binary_join(whole, pa.scalar(b" ", pa.large_binary())).to_pylist() if len(words) else []


def _chunks(docs: DataFrame, held_out: Column) -> DataFrame:
    """Some documents a row: their words once, the distinct pairs of neighbouring tokens (by places of
    words, in order), tokens as places in those pairs, and training counts of words and pairs."""

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, sizes, words, size, n_chunks = [], [], [], [], 0, 0

        def done() -> pa.RecordBatch:
            coded = pa.concat_arrays(words).dictionary_encode()
            known = coded.dictionary  # END stands before these
            words.clear()
            place, n_tokens = coded.indices.to_numpy().astype(np.int64) + 1, np.concatenate(sizes)
            training = np.repeat(~np.array(held, bool), n_tokens + 1)
            token, pair = _token_pairs(place, n_tokens, len(known) + 1)
            counts = np.bincount(token[training], minlength=len(known) + 1)
            pairs, pair_of = np.unique(pair, return_inverse=True)
            pair_counts = np.bincount(pair_of[training], minlength=len(pairs))
            name = (TaskContext.get().partitionId() << 32) + n_chunks
            packed = _pack(pair_of), _pack(counts), _pack(np.diff(pairs, prepend=0)), _pack(pair_counts)
            return _record(CHUNKS, [(name, ids, held, n_tokens.tolist(), _pack_words([END, *_joined(known)]), len(known) + 1, *packed, int(counts.sum()))])

        for batch in batches:
            texts, at, weighed = batch.column("text"), 0, 0
            weigh = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
            while at < len(texts):  # up to the text that fills a chunk
                end = min(len(texts), 1 + int(np.searchsorted(weigh, weighed + CHUNK - size)))
                found, n_words = _words(texts.slice(at, end - at))
                ids += batch.column("doc_id").slice(at, end - at).to_pylist()
                held += batch.column("held").slice(at, end - at).to_pylist()
                sizes.append(n_words)
                words.append(found)
                size += int(weigh[end - 1]) - weighed
                at, weighed = end, int(weigh[end - 1])
                if size >= CHUNK:
                    yield done()
                    ids, held, sizes, words, size, n_chunks = [], [], [], [], 0, n_chunks + 1
                    del found
                    pa.default_memory_pool().release_unused()
        if ids:
            yield done()

    return docs.select("doc_id", held_out.alias("held"), "text").mapInArrow(chunk, CHUNKS)


def _token_pairs(place: np.ndarray, sizes: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """All tokens, ends included, as places of words; and each with the one before, as one number."""
    token = np.zeros(int((sizes + 1).sum()), np.int64)
    inside = np.ones(len(token), bool)
    inside[np.cumsum(sizes + 1) - 1] = False
    token[inside] = place
    return token, np.concatenate(([0], token[:-1])) * n_words + token


def _scramble(x: np.ndarray, bits: int) -> np.ndarray:
    """Numbers of so many bits, each to another one: no two to the same."""
    mask, half = np.uint64((1 << bits) - 1), np.uint64(bits // 2)
    for multiplier in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x * np.uint64(multiplier)) & mask
        x = x ^ (x >> half)
    return x


class _Pairs:
    """A chunk's distinct pairs, and the number that each bears in all chunks: that of its words, which
    come from the words' buckets, so different pairs have different numbers."""

    def __init__(self, row: dict, settings: dict) -> None:
        n, width = row["n_words"], settings["width"]
        self.slots: list[tuple[int, np.ndarray, np.ndarray]] = []  # bucket, places in words, places in the bucket
        self.count, self.owns, ids = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, np.uint64)
        for a in row["word_answers"]:
            at = np.cumsum(_unpack(a["a"]))
            place = _unpack(a["b"])
            self.slots.append((a["bucket"], at, place))
            self.count[at], self.owns[at] = _unpack(a["c"]), _unpack(a["d"])
            ids[at] = (np.uint64(a["bucket"]) << np.uint64(settings["place_bits"])) | place.astype(np.uint64)
        pair = np.cumsum(_unpack(row["pairs"]))
        self.context = pair // n
        self.word = pair - self.context * n
        self.ids = ids
        keys = _scramble((ids[self.context] << np.uint64(width)) | ids[self.word], 2 * width)
        self.order = np.argsort(keys)
        self.keys = keys


def _runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """Value, begin and end of each run of a sorted array."""
    begin = np.flatnonzero(np.diff(x, prepend=-1))
    return list(zip(x[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(x)]))


def _word_requests(chunks: DataFrame, buckets: int) -> DataFrame:
    """The words of each chunk, dealt into buckets by hash, with their places and training counts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, counts = np.array(_unpack_words(row["words"]), object), _unpack(row["counts"])
                bucket = (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                slices = [(b, order[begin:end]) for b, begin, end in _runs(bucket[order])]
                yield _record(ASKED, [(b, row["chunk"], _pack(np.diff(at, prepend=0)), _pack_words(list(words[at])), _pack(counts[at])) for b, at in slices])

    return chunks.select("chunk", "words", "counts").mapInArrow(ask, ASKED)


def _pair_requests(joined: DataFrame, buckets: int, settings: dict) -> DataFrame:
    """The pairs of each chunk as sorted numbers, dealt into buckets by their range, with training counts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = 2 * settings["width"]
        starts = np.array([(b << bits) // buckets for b in range(buckets)], np.uint64)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                p = _Pairs(row, settings)
                keys, counts = p.keys[p.order], _unpack(row["pair_counts"])[p.order]
                slices = [(b, slice(begin, end)) for b, begin, end in _runs(np.searchsorted(starts, keys, "right") - 1)]
                yield _record(ASKED, [(b, row["chunk"], None, _pack(np.diff(keys[s].view(np.int64), prepend=0)), _pack(counts[s])) for b, s in slices])

    return joined.select("chunk", "n_words", "pairs", "pair_counts", "word_answers").mapInArrow(ask, ASKED)


def _gathered(requests: DataFrame, answer: Callable[[int, list[dict]], pa.RecordBatch], schema: str) -> DataFrame:
    """answer(bucket, its rows) for each bucket, one bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["bucket"] != held[0]["bucket"]:
                    yield answer(held[0]["bucket"], held)
                    held = []
                held.append(row)
        if held:
            yield answer(held[0]["bucket"], held)

    return requests.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(run, schema)


def _count_words(bucket: int, rows: list[dict]) -> pa.RecordBatch:
    named = [_unpack_words(r["names"]) for r in rows]
    known = {w: i for i, w in enumerate(sorted(set().union(*named)))}  # in order, whatever the chunks
    return _answers(bucket, rows, [np.fromiter(map(known.__getitem__, n), np.int64, len(n)) for n in named], len(known), True)


def _count_pairs(bucket: int, rows: list[dict]) -> pa.RecordBatch:
    keys = [np.cumsum(_unpack(r["names"])) for r in rows]
    unique, place = np.unique(np.concatenate(keys), return_inverse=True)
    return _answers(bucket, rows, np.split(place, np.cumsum([len(k) for k in keys])[:-1]), len(unique), False)


def _answers(bucket: int, rows: list[dict], places: list[np.ndarray], n: int, tell_places: bool) -> pa.RecordBatch:
    """To each chunk: the counts of what it named over all chunks, and which of it the chunk owns
    (was the first to name). The bucket's sums go with the first answer."""
    counts, owned = np.zeros(n, np.int64), np.zeros(n, bool)
    for r, p in zip(rows, places):
        counts[p] += _unpack(r["counts"])  # a chunk names a thing once
    out = []
    for i, (r, p) in enumerate(zip(rows, places)):
        own = ~owned[p]
        owned[p] = True
        sums = (n, int((counts > 0).sum()), int((counts == 1).sum()), int((counts == 2).sum())) if not i else (0, 0, 0, 0)
        out.append((r["chunk"], bucket, r["at"], _pack(p) if tell_places else None, _pack(counts[p]), _pack(own), *sums))
    return _record(ANSWERED, out)


def _collected(answers: DataFrame, name: str) -> tuple[DataFrame, dict]:
    """The answers to each chunk as one row, and their sums: largest bucket, types, ones, twos."""
    told = F.array_sort(F.collect_list(F.struct("bucket", "a", "b", "c", "d"))).alias(name)
    sums = [F.max("named").alias("named"), *(F.sum(c).alias(c) for c in ("types", "ones", "twos"))]
    written = _by_chunk(answers.groupBy("chunk").agg(told, *sums), shuffle_partitions(answers.sparkSession))
    row = written.agg(F.coalesce(F.max("named"), F.lit(0)).alias("named"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "ones", "twos"))).first()
    return written.select("chunk", name), row.asDict()


class _State(_Pairs):
    """What a chunk knows of its words and pairs, and the seatings that follow from it."""

    def __init__(self, row: dict, settings: dict) -> None:
        super().__init__(row, settings)
        self.settings = settings
        self.seated: dict[int, np.ndarray] = {}
        self.pair_count, self.pair_owned = np.zeros(len(self.keys), np.int64), np.zeros(len(self.keys), bool)
        self.pair_count[self.order] = np.concatenate([_unpack(a["c"]) for a in row["pair_answers"]])
        self.pair_owned[self.order] = np.concatenate([_unpack(a["d"]) for a in row["pair_answers"]])

    def start(self) -> tuple[np.ndarray, np.ndarray]:
        """Before any sweep: the parent's probabilities of the words, and tables of the contexts."""
        s = self.settings
        parent = (self.count + 0.5) / (s["tokens"] + 0.5 * (s["types"] + 1))
        return parent, self.count * (s["pairs"] / max(1, s["tokens"]))

    def _seated(self, row: dict, sweep: int, chain: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """After a sweep: the words' customers and tables in the parent, and the contexts' tables."""
        if sweep not in self.seated:
            found = np.zeros((CHAINS, 3, len(self.count)), np.int64)
            seated = {x["bucket"]: x for x in row[f"seated{sweep}"]}
            for bucket, at, _ in self.slots:
                for k, field in enumerate("abc"):
                    for into, part in zip(found, np.split(_unpack(seated[bucket][field]), CHAINS)):
                        into[k][at] = part
            self.seated[sweep] = found
        return tuple(self.seated[sweep][chain])

    def after(self, row: dict, sweep: int, chain: int) -> tuple[np.ndarray, np.ndarray]:
        """After a sweep: the parent's predictive probabilities of the words, and tables of the contexts."""
        s = self.settings
        customers, tables, opened = self._seated(row, sweep, chain)
        all_customers, all_tables = s["customers"][sweep][chain], s["tables"][sweep][chain]
        d = s["word_discount"]
        rest = (THETA + d * all_tables) / (THETA + all_customers) / (s["types"] + 1)
        return (customers - d * tables) / (THETA + all_customers) + rest, opened

    def measure(self, row: dict, sweep: int, chain: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, with a draw of the parent's probabilities given its seating; those of other words than
        the given ones are 1."""
        s = self.settings
        customers, tables, opened = self._seated(row, sweep, chain)
        rest = _rest_mass(s, sweep, chain)
        parent = np.ones(len(customers))
        masses = _masses(self.ids[words], customers[words], tables[words], s["word_discount"], sweep, chain)
        parent[words] = (masses / MASS + rest / (s["types"] + 1)) / (s["masses"][sweep][chain] / MASS + rest)
        return parent, opened

    def seat(self, row: dict, sweep: int, some: np.ndarray) -> Iterator[np.ndarray]:
        """By chain, the tables of some pairs (given by their places) in the given sweep: the same in every
        chunk that holds the pair, as they follow from counts and hashes.

        Given the parent's probabilities and, for each context, a gamma number of its tables so far, pairs
        don't depend on one another. Chains come one after another, so that one's numbers are held at a time."""
        count = self.pair_count[some]
        at = np.flatnonzero(count > 1)
        several, count, tables = some[at], count[at], np.minimum(count, 1)
        key, context, word = mix64(self.keys[several]), self.context[several], self.word[several]
        d = self.settings["pair_discount"]
        words, contexts = (np.flatnonzero(np.bincount(x, minlength=len(self.count))) for x in (word, context))
        for chain in range(CHAINS):
            parent, opened = self.measure(row, sweep - 1, chain, words) if sweep else self.start()
            gamma = np.zeros(len(self.count))
            gamma[contexts] = hashed_gamma(self.ids[contexts], THETA / d + opened[contexts], 2 * (chain + CHAINS * sweep))
            uniform = hashed_uniform(key, 1 + chain + CHAINS * sweep)
            tables[at] = draw_tables(count, np.log(parent)[word], None, THETA, d, uniform, gamma[context])
            yield tables


class _Frequent:
    """Tables of frequent pairs, summed over the kept seatings, as this worker drew them for earlier chunks of a
    run: they are the same in every chunk. Of more than REMEMBERED pairs, those of most customers stay."""

    def __init__(self, run: str) -> None:
        self.run, self.least = run, FEW
        self.keys, self.sums, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.float32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some sorted keys are known, and the sums of these."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), self.sums
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return known, self.sums[at[known]]

    def add(self, keys: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
        """Sorted keys that are not known yet."""
        new = counts.astype(np.float32) > self.least
        if not new.any():
            return
        at = np.searchsorted(self.keys, keys[new])
        self.keys = np.insert(self.keys, at, keys[new])
        self.sums = np.insert(self.sums, at, sums[new])
        self.counts = np.insert(self.counts, at, counts[new])
        if (over := len(self.keys) - REMEMBERED) > 0:
            over += REMEMBERED // 8  # not with each chunk
            self.least = np.partition(self.counts, over)[over]
            stay = self.counts > self.least
            self.keys, self.sums, self.counts = self.keys[stay], self.sums[stay], self.counts[stay]


_LAST_RUN = [_Frequent("")]


def _frequent(run: str) -> _Frequent:
    """What this worker remembers of a run; of the runs before, nothing."""
    if _LAST_RUN[0].run != run:
        _LAST_RUN[0] = _Frequent(run)
    return _LAST_RUN[0]


def _kept_tables(state: _State, row: dict, frequent: _Frequent) -> np.ndarray:
    """The tables of each pair of a chunk, summed over the kept seatings."""
    count = state.pair_count
    sums, todo = np.minimum(count, 1) * (CHAINS * KEPT), count > 1
    often = state.order[count[state.order] > FEW]  # by key
    known, of_known = frequent.find(state.keys[often])
    sums[often[known]], todo[often[known]] = of_known, False
    draw = np.flatnonzero(todo)
    sums[draw] = 0
    for sweep in range(SWEEPS - KEPT, SWEEPS):
        for tables in state.seat(row, sweep, draw):
            sums[draw] += tables
    fresh = often[~known]
    frequent.add(state.keys[fresh], sums[fresh], count[fresh])
    return sums


def _masses(ids: np.ndarray, customers: np.ndarray, tables: np.ndarray, discount: float, sweep: int, chain: int) -> np.ndarray:
    """Gamma numbers of words in the parent's seating, in units of 1 / MASS: their shares are a draw of the
    parent's probabilities."""
    return np.rint(hashed_gamma(ids, customers - discount * tables, 2 * (chain + CHAINS * sweep) + 1) * MASS)


def _rest_mass(settings: dict, sweep: int, chain: int) -> float:
    """The gamma number of what the parent leaves to its own base."""
    return float(np.random.default_rng([1, sweep, chain]).standard_gamma(THETA + settings["word_discount"] * settings["tables"][sweep][chain]))


def _sweep(joined: DataFrame, settings: dict, sweep: int) -> DataFrame:
    """Each chunk seats the pairs that it owns and tells the words' buckets of their tables."""
    held = joined.sparkSession.sparkContext.broadcast(settings)

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                state = _State(row, held.value)
                n, own = len(state.count), np.flatnonzero(state.pair_owned)
                own_word, own_context = state.word[own], state.context[own]
                dish, context = [], []
                for tables in state.seat(row, sweep, own):
                    dish.append(np.bincount(own_word, tables, n).astype(np.int64))
                    context.append(np.bincount(own_context, tables, n).astype(np.int64))
                told = [(b, row["chunk"], _pack(place), _pack(np.concatenate([d[at] for d in dish])), _pack(np.concatenate([c[at] for c in context]))) for b, at, place in state.slots]
                yield _record(ASKED, told)

    return joined.mapInArrow(seat, ASKED)


def _seat_words(sweep: int, settings: dict) -> Callable[[int, list[dict]], pa.RecordBatch]:
    """For a bucket of words: customers in the parent restaurant, tables drawn there given a gamma number of
    the parent's tables so far, masses, and the tables of each word as a context. Random numbers go by the
    words' places in the bucket."""
    types, discount, place_bits = settings["types"], settings["word_discount"], settings["place_bits"]
    before = settings["tables"][sweep - 1] if sweep else [types] * CHAINS
    gammas = [float(np.random.default_rng([0, sweep, chain]).standard_gamma(THETA / discount + before[chain])) for chain in range(CHAINS)]

    def answer(bucket: int, rows: list[dict]) -> pa.RecordBatch:
        places = [_unpack(r["at"]) for r in rows]
        n = int(max(p.max() for p in places)) + 1
        customers, opened, tables = (np.zeros((CHAINS, n), np.int64) for _ in range(3))
        for r, p in zip(rows, places):
            for sums, told in (customers, r["names"]), (opened, r["counts"]):
                for of_chain, part in zip(sums, np.split(_unpack(told), CHAINS)):
                    of_chain[p] += part
        ids = (np.uint64(bucket) << np.uint64(place_bits)) | np.arange(n, dtype=np.uint64)
        masses = []
        for chain in range(CHAINS):
            uniform = hashed_uniform(mix64(ids), 1 + chain + CHAINS * sweep)
            tables[chain] = draw_tables(customers[chain], np.full(n, -np.log(types + 1)), None, THETA, discount, uniform, np.full(n, gammas[chain]))
            masses.append(int(_masses(ids, customers[chain], tables[chain], discount, sweep, chain).sum()))
        none = [0] * CHAINS
        told = lambda x, p: _pack(np.concatenate([of_chain[p] for of_chain in x]))
        return _record(SEATED, [
            (r["chunk"], bucket, told(customers, p), told(tables, p), told(opened, p), *((customers.sum(axis=1).tolist(), tables.sum(axis=1).tolist(), masses) if not i else (none, none, none)))
            for i, (r, p) in enumerate(zip(rows, places))
        ])

    return answer


def _score(joined: DataFrame, settings: dict) -> DataFrame:
    """Sums over the tokens of each document."""
    held = joined.sparkSession.sparkContext.broadcast(settings)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = held.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                state, sizes = _State(row, s), np.array(row["sizes"], np.int64)
                seatings, discount = CHAINS * KEPT, s["pair_discount"]
                chance = state.pair_count * float(seatings) - discount * _kept_tables(state, row, _frequent(s["run"]))
                for sweep in range(SWEEPS - KEPT, SWEEPS):
                    for chain in range(CHAINS):
                        parent, opened = state.after(row, sweep, chain)
                        chance += (THETA + discount * opened)[state.context] * parent[state.word]
                chance /= (seatings * (THETA + state.count))[state.context]
                pair_of = _unpack(row["tokens"])
                token = state.word[pair_of]
                doc = np.repeat(np.arange(len(sizes)), sizes + 1)
                sums = lambda x: np.bincount(doc, x, len(sizes)).astype(float)
                known = np.bincount(doc, (state.count > 0)[token], len(sizes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(sizes + 1), pa.array(known), pa.array(sums(np.log10(state.count + 0.1)[token])), pa.array(sums(np.log10(chance)[pair_of]))],
                    names=[f.split()[0] for f in SCORES.split(", ")],
                )

    return joined.mapInArrow(score, SCORES)


def score_texts(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row of
    docs (doc_id, text); learns from the rows for which held_out is false.

    Tokens are the words between ASCII white space, in ASCII lower case, and the end. base_score is
    the unigram model with 0.1 added; score is log10 of the text's probability, the product of its
    tokens' predictive probabilities, each averaged over the last KEPT seatings of CHAINS chains;
    perplexity is the inverse of their geometric mean. As in the
    base, words without training tokens are one type: V words and the unknown word sum to 1.

    1. Documents are gathered into chunks of CHUNK bytes; a chunk names each word, and each pair of
       neighbouring words, once.
    2. Words are dealt into buckets by hash and counted there; buckets answer the chunks and number the
       words. Then pairs, which have a number for each pair of words, are dealt into buckets and counted.
       No table of words or pairs is ever in one place, and a frequent word or pair is named once a
       chunk. Buckets also say which chunk owns a thing, so that sums over distinct things add up. Their
       number grows with the tokens, BUCKET for each, so their memory is bounded.
    3. A Gibbs sweep takes contexts and the parent in turn. A context's restaurant gets a gamma number,
       given its tables; given that and the parent's probabilities, the tables of its pairs don't depend
       on one another, so every chunk draws those of its own pairs. What a chunk owns goes to the words'
       buckets: customers of the parent, whose tables are drawn alike (a gamma number, then all words),
       and then its probabilities, a draw given its seating. Draws follow from hashes of words and
       pairs, so chunks agree on what they share.
    4. Chunks add up their documents. Only sums come to the driver.

    Runs agree, however the rows are partitioned. A null text is the empty text: one token. Rows that
    share a doc_id are scored each. Without training rows every token is the unknown word, of
    probability 1. There may be 2**32 different words at most (a clear error beyond).
    """
    parts = shuffle_partitions(docs.sparkSession)
    chunks = _by_chunk(_chunks(docs.select("doc_id", "text"), F.coalesce(held_out, F.lit(True)).cast("boolean")), parts)
    all_tokens = F.sum(F.size("sizes") + F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n))
    totals = chunks.agg(F.coalesce(F.sum("trained"), F.lit(0)).alias("tokens"), F.coalesce(all_tokens, F.lit(0)).alias("all")).first()
    buckets = 1 + int(totals["all"]) // BUCKET
    word_answers, words = _collected(_gathered(_word_requests(chunks, buckets), _count_words, ANSWERED), "word_answers")
    place_bits = max(1, int(words["named"]).bit_length())
    width = place_bits + (buckets - 1).bit_length()
    if width > 32:
        raise ValueError("too many different words to number their pairs in 64 bits")
    settings = {"run": uuid.uuid4().hex, "tokens": totals["tokens"], "types": words["types"], "place_bits": place_bits, "width": width, "word_discount": discount_of(words["ones"], words["twos"]), "customers": [], "tables": [], "masses": []}
    joined = chunks.join(word_answers, "chunk")
    pair_answers, pairs = _collected(_gathered(_pair_requests(joined, buckets, settings), _count_pairs, ANSWERED), "pair_answers")
    settings = settings | {"pairs": pairs["types"], "pair_discount": discount_of(pairs["ones"], pairs["twos"])}
    joined = joined.join(pair_answers, "chunk")
    sums = "customers", "tables", "masses"
    narrow = ["chunk", "n_words", "pairs", "word_answers", "pair_answers"]
    for sweep in range(SWEEPS):
        sat = _gathered(_sweep(joined.select(*narrow, *([f"seated{sweep - 1}"] if sweep else [])), settings, sweep), _seat_words(sweep, settings), SEATED)
        per_chain = [F.sum(F.get(c, i)).alias(f"{c}{i}") for c in sums for i in range(CHAINS)]
        sat = _by_chunk(sat.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "a", "b", "c")).alias(f"seated{sweep}"), *per_chain), parts)
        all_of = sat.agg(*(F.coalesce(F.sum(f"{c}{i}"), F.lit(0)).alias(f"{c}{i}") for c in sums for i in range(CHAINS))).first()
        settings = settings | {c: [*settings[c], [all_of[f"{c}{i}"] for i in range(CHAINS)]] for c in sums}
        joined = joined.join(sat.select("chunk", f"seated{sweep}"), "chunk")
    tokens, types = settings["tokens"], settings["types"]
    wanted = [*narrow, "doc_ids", "held", "sizes", "tokens", *(f"seated{k}" for k in range(SWEEPS - KEPT - 1, SWEEPS) if k >= 0)]
    return _score(joined.select(*wanted), settings).select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * float(np.log10(tokens + 0.1 * (types + 1)))).alias("base_score"),
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
