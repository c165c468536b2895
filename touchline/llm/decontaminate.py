"""Benchmark decontamination with a generalised suffix automaton over item words.

The automaton holds every run of consecutive words of every benchmark item. A document's words are
streamed through it; after each word it knows the longest suffix that is a run of some item. When
that length reaches the window, the last `window` words are a window of an item and are hit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCodes, materialize, mix64, set_aside, utf8_bytes

#: ASCII letters to lower case, digits kept, bytes from 0x80 kept, every other ASCII byte to a space.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())

#: Columns that a scan adds.
ADDED = ["n_words", "spans", "items", "longest"]


def item_words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class SuffixAutomaton:
    """Runs of consecutive words of all items, for streaming words and naming the items they occur in.

    Words are small integers. Items of fewer than `window` words count only whole.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.shortest = window
        ends: dict[int, list[tuple[int, str | None]]] = {}
        coded = []
        for name, words in items:
            if not words:
                continue
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            coded.append((name, codes))
            self.shortest = min(self.shortest, len(codes))
            last = 0
            for code in codes:
                last = self._extend(last, code)
        # by state, the state of its last `window` words (-1: it has fewer)
        self.top = [-1] * len(self.length)
        by_length = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for state in by_length:
            shorter = self.link[state]
            self.top[state] = self.top[shorter] if self.length[shorter] >= window else state if self.length[state] >= window else -1
        #: by state of a whole window, the items that hold it
        self.windows: dict[int, set[str | None]] = {}
        for name, codes in coded:
            if len(codes) < window:
                ends.setdefault(self._walk(codes), []).append((len(codes), name))
            else:
                state, matched = 0, 0
                for code in codes:
                    state, matched = self.next[state][code], matched + 1
                    if matched >= window:
                        state = self.top[state]
                        self.windows.setdefault(state, set()).add(name)
        #: by state, the short items that end there: size, their names, and the state that has the next shorter ones
        self.whole: dict[int, tuple[int, set[str | None], int]] = {}
        shorter_at = [0] * len(self.length)
        for state in by_length:
            link = self.link[state]
            shorter_at[state] = link if link in self.whole else shorter_at[link]
            if state in ends:
                # items that end in one state are as long as each other: a shorter one would end in a link
                self.whole[state] = (max(size for size, _ in ends[state]), {name for _, name in ends[state]}, shorter_at[state])
        self.short_at = [state if state in self.whole else shorter_at[state] for state in range(len(self.length))]

    def _walk(self, codes: list[int]) -> int:
        state = 0
        for code in codes:
            state = self.next[state][code]
        return state

    def _split(self, state: int, code: int, child: int) -> int:
        """A copy of child for the strings that end at state + code."""
        copy = len(self.length)
        self.next.append(dict(self.next[child]))
        self.length.append(self.length[state] + 1)
        self.link.append(self.link[child])
        self.link[child] = copy
        while state != -1 and self.next[state].get(code) == child:
            self.next[state][code] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, code: int) -> int:
        child = self.next[last].get(code)
        if child is not None:
            return child if self.length[child] == self.length[last] + 1 else self._split(last, code, child)
        new = len(self.length)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        state = last
        while state != -1 and code not in self.next[state]:
            self.next[state][code] = new
            state = self.link[state]
        if state != -1:
            child = self.next[state][code]
            self.link[new] = child if self.length[child] == self.length[state] + 1 else self._split(state, code, child)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str | None], int]:
        """Hit spans as [start, end, start, end, ...] of word positions, the items, the longest match."""
        n = len(words)
        if n < self.shortest or not self.vocabulary:
            return [], set(), 0
        codes = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, n)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], codes >= 0, [False]))))
        runs = edges.reshape(-1, 2)
        runs = runs[runs[:, 1] - runs[:, 0] >= self.shortest]
        spans: list[int] = []
        items: set[str | None] = set()
        seen: set[int] = set()  # states whose items are in the list
        longest = 0
        follow, link, length, top, short_at = self.next, self.link, self.length, self.top, self.short_at
        for begin, end in runs.tolist():
            state = matched = 0
            for at, code in enumerate(codes[begin:end].tolist(), begin + 1):
                while state and code not in follow[state]:
                    state = link[state]
                    matched = length[state]
                if code in follow[state]:
                    state, matched = follow[state][code], matched + 1
                reach = 0
                if matched >= self.window:
                    reach = self.window
                    if top[state] not in seen:
                        seen.add(top[state])
                        items |= self.windows[top[state]]
                short = short_at[state]
                while short:
                    size, names, following = self.whole[short]
                    if size <= matched:
                        reach = max(reach, size)
                        if short in seen:  # and so are the shorter ones
                            break
                        seen.add(short)
                        items |= names
                    short = following
                if reach:
                    longest = max(longest, matched)
                    start = at - reach
                    while spans and start <= spans[-1]:  # joins the spans that it meets
                        start = min(start, spans[-2])
                        del spans[-2:]
                    spans += [start, at]
        return spans, items, longest


def _merge(one: list[int], other: list[int]) -> list[int]:
    out: list[int] = []
    for start, end in sorted([*zip(one[::2], one[1::2]), *zip(other[::2], other[1::2])]):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[SuffixAutomaton]:
    """Automata over at most block_words words each (or one longer item), read one after another."""
    block, words = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary"))
    for name, text in rows.toLocalIterator():
        found = item_words(bytes(text) if text is not None else None)
        if block and words + len(found) > block_words:
            yield SuffixAutomaton(block, window)
            block, words = [], 0
        block.append((name, found))
        words += len(found)
    yield SuffixAutomaton(block, window)


#: Bits of the table that tells which runs of words a benchmark of several blocks holds: 8 MB, always.
ANCHOR_BITS = 1 << 26


def _run_hashes(words: list[bytes], codes: WordCodes, size: int) -> np.ndarray:
    """A hash for each run of `size` words."""
    w = codes.of(words)
    h = np.full(max(0, len(w) - size + 1), size, np.uint64)
    for i in range(size):
        h = (h ^ w[i : len(w) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return mix64(h)


def _anchors(benchmark: DataFrame, window: int) -> tuple[np.ndarray, list[int]]:
    """A bit table of ANCHOR_BITS over the hashes of all windows of the benchmark, and their sizes."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in batches:
            sizes, places = [], []
            for text in utf8_bytes(batch.column("text")):
                if words := item_words(text):
                    size = min(window, len(words))
                    h = np.unique(_run_hashes(words, codes, size) % np.uint64(ANCHOR_BITS)).astype(np.int64)
                    sizes.append(np.full(len(h), size))
                    places.append(h)
            codes.forget()
            sizes, places = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (sizes, places))
            yield pa.RecordBatch.from_arrays([pa.array(sizes.astype(np.int32)), pa.array(places)], names=["size", "place"])

    rows = benchmark.select("text").mapInArrow(hashed, "size int, place long")
    tables = rows.groupBy(F.shiftright("place", 15).alias("row")).agg(F.bitmap_construct_agg(F.pmod("place", F.lit(1 << 15))).alias("table"), F.collect_set("size").alias("sizes"))
    bits, sizes = np.zeros(ANCHOR_BITS >> 3, np.uint8), set()
    for r in tables.toLocalIterator():  # ANCHOR_BITS / 2**15 rows of 4 KB at most
        bits[r["row"] << 12 : (r["row"] + 1) << 12] = np.frombuffer(r["table"], np.uint8)
        sizes |= set(r["sizes"])
    return bits, sorted(sizes)


def _with_anchors(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """docs as two: the rows whose text may hold a window of the benchmark, and those in which none of
    its runs of words has the hash of one. Either reads docs once."""
    held = docs.sparkSession.sparkContext.broadcast(_anchors(benchmark, window))

    def split(wanted: bool) -> Callable:
        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits, sizes = held.value
            codes = WordCodes()
            for batch in batches:
                keep, counts = [], []
                for text in utf8_bytes(batch.column("text")):
                    words = item_words(text)
                    places = (_run_hashes(words, codes, size) % np.uint64(ANCHOR_BITS) for size in sizes if size <= len(words))
                    keep.append(any((bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).any() for p in places) == wanted)
                    counts.append(len(words))
                codes.forget()
                yield batch.set_column(batch.schema.get_field_index("n_words"), "n_words", pa.array(counts, pa.int32())).filter(pa.array(keep, pa.bool_()))

        return pick

    return docs.mapInArrow(split(True), docs.schema), docs.mapInArrow(split(False), docs.schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 100_000, then: Callable | None = None) -> DataFrame:
    """All rows and columns of docs, and where benchmark items occur in the text.

    Adds n_words int, spans array<int> (hit word positions, [start, end) after [start, end), joined),
    items array<string> (ids of the items with occurring windows, distinct), longest int (longest
    match). A column of docs with one of these names is replaced.

    The benchmark is read in blocks of at most block_words words; each block's automaton is
    broadcast (two states a word at most, so its size is bounded by block_words) and documents
    are streamed through it once. One block is the usual case. With more, documents none of whose
    runs of words has a hash that a window has are set apart first, by a bit table of fixed size;
    the others are written to the shared folder and go through one block after the other.

    Null and empty texts have no words. Items without words have no window. Items without an id
    mark words but are not listed. Rows that share a doc_id are scanned apart. An empty benchmark
    hits nothing. `then` (batches to batches, with the columns of docs) may follow in the same task.
    """
    spark = docs.sparkSession
    added = ADDED
    out = docs.select(*(c for c in docs.columns if c not in added)).select(
        "*", F.lit(0).alias("n_words"), F.array().cast("array<int>").alias("spans"), F.array().cast("array<string>").alias("items"), F.lit(0).alias("longest")
    )
    schema = out.schema
    blocks = _blocks(benchmark, window, block_words)
    following, clean = next(blocks), None
    for i in count():
        automaton, following = following, next(blocks, None)
        if following is not None and not i:
            out, clean = _with_anchors(out, benchmark, window)
            out = materialize(out)
        held = spark.sparkContext.broadcast(automaton)

        def scan(batches: Iterator[pa.RecordBatch], held=held, first=not i) -> Iterator[pa.RecordBatch]:
            found_by = held.value
            for batch in batches:
                counts, spans, items, longest = [], [], [], []
                before = [None] * batch.num_rows if first else zip(*(batch.column(c).to_pylist() for c in added[1:]))
                for text, old in zip(utf8_bytes(batch.column("text")), before):
                    words = item_words(text)
                    hit, names, most = found_by.scan(words)
                    names.discard(None)
                    if old:
                        hit, names, most = _merge(old[0], hit), names | set(old[1]), max(most, old[2])
                    counts.append(len(words))
                    spans.append(hit)
                    items.append(sorted(names))
                    longest.append(most)
                new = [pa.array(counts, pa.int32()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int32())]
                kept = [n for n in batch.schema.names if n not in added]
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + new, names=kept + added)

        out = materialize(out) if i else out
        if following is None:
            out = out.mapInArrow((lambda batches: then(scan(batches))) if then else scan, docs.schema if then else schema)
            return out if clean is None else out.unionByName(clean.mapInArrow(then, docs.schema) if then else clean)
        out = out.mapInArrow(scan, schema)


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, coverage,
    longest. Documents without words have coverage 0."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark, window)
    hit = F.aggregate(F.sequence(F.lit(0), F.size("spans") - 1, F.lit(2)), F.lit(0).cast("long"), lambda a, i: a + F.get("spans", i + 1) - F.get("spans", i))
    n_hit = F.when(F.size("spans") == 0, F.lit(0).cast("long")).otherwise(hit)
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.when(F.col("n_words") > 0, n_hit / F.col("n_words")).otherwise(F.lit(0.0)).alias("coverage"),
        "longest",
    )


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """docs without benchmark passages, with the columns of docs.

    Hit spans go from the text, together with what stands between their words; a document of which
    more than max_coverage of the words is hit goes altogether. Untouched texts stay as they are,
    byte for byte; where text is cut, n_chars (if there is one) becomes its new length.
    """
    docs, back = set_aside(docs, ADDED)
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(batch.column("spans").to_pylist(), batch.column("n_words").to_pylist()))
            keep = [sum(s[1::2]) - sum(s[::2]) <= max_coverage * n for s, n in rows]
            if any(s for s, _ in rows):
                texts = [_without(t, s) if s and k else t for t, (s, _), k in zip(utf8_bytes(batch.column("text")), rows, keep)]
                column = pa.array(texts, pa.binary()).cast(batch.column("text").type)
                batch = batch.set_column(batch.schema.get_field_index("text"), "text", column)
                if "n_chars" in names:
                    sizes = [len(t.decode()) if s and k else n for t, (s, _), k, n in zip(texts, rows, keep, batch.column("n_chars").to_pylist())]
                    batch = batch.set_column(batch.schema.get_field_index("n_chars"), "n_chars", pa.array(sizes, batch.column("n_chars").type))
            yield batch.select(names).filter(pa.array(keep))

    return find_contamination(docs, benchmark, window, then=cut).withColumnsRenamed(back)


def _without(text: bytes, spans: list[int]) -> bytes:
    """text without the words of spans; a word's place is found in the separated bytes."""
    flat = np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flat, [False]))))
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for begin, end in zip(spans[::2], spans[1::2]):
        out.append(text[at : starts[begin]])
        at = int(ends[end - 1])
    return b"".join([*out, text[at:]])
