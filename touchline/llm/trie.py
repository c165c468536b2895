"""Prefix trie of conversations: intervals of sorted conversations with a common prefix."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions
from .select import join_counted

#: Bytes that stand for a turn.
DIGEST = 16
#: Ids of members that are handed on in one row.
CHUNK = 4096
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

# What scanning a block gives: pieces of nodes, runs of members that end at a node, the block's edges.
PIECE, MEMBERS, EDGES = 0, 1, 2
SCANNED = (
    "kind int, block int, l long, lo int, hi int, n long, total long, own long, leaves long, least long, kids long, first_total long, deep int, "
    "before array<long>, ends string, parent_l long, edge boolean, chunk long, ids string, first binary, first_before array<long>, last binary, inner int"
)
FIELDS = [f.split()[0] for f in SCANNED.split(", ")]
ARROW = pa.schema([(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[f.split()[1]]) for f in SCANNED.split(", ")])


# --- conversations


def turn_digest(role: Column, text: Column) -> Column:
    """DIGEST bytes of SHA-256 of a role and a text; no two different pairs are written alike."""
    return F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * DIGEST))


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, digests (of all turns, one after the other), lengths (code points of the texts).

    Turns are ordered by `turn`, nulls first; those that agree in it by their digests. Null roles and
    texts are empty. Rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", turn_digest(role, text).alias("digest"), F.length(text).cast("long").alias("length"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "length"))).alias("t"))
    digests = F.unhex(F.array_join(F.transform("t", lambda t: F.hex(t["digest"])), ""))
    return whole.select("conv_id", digests.alias("digests"), F.col("t.length").alias("lengths"))


def with_shared_starts(convs: DataFrame, every: int, most: int, count: Column) -> DataFrame:
    """Conversations whose first `count` turns (below `most`; of column conv_id) are those of
    conversation conv_id - conv_id % every (all of its turns if fewer, none if it isn't there); their
    own turns after the first `count` follow. convs should be cheap to read twice."""
    starts = convs.filter(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("__base"), F.substr("digests", F.lit(1), F.lit(DIGEST * most)).alias("__digests"), F.slice("lengths", 1, most).alias("__lengths")
    )
    joined = convs.withColumn("__base", F.col("conv_id") - F.col("conv_id") % every).withColumn("__n", count).join(starts, "__base", "left")
    none, empty = F.lit(b""), F.array().cast("array<long>")
    digests = F.concat(F.coalesce(F.substr("__digests", F.lit(1), F.col("__n") * DIGEST), none), F.substr("digests", F.col("__n") * DIGEST + 1, F.octet_length("digests")))
    tail = F.slice("lengths", F.col("__n") + 1, F.greatest(F.lit(0), F.size("lengths") - F.col("__n")))
    return joined.select("conv_id", digests.alias("digests"), F.concat(F.coalesce(F.slice("__lengths", F.lit(1), F.col("__n")), empty), tail).alias("lengths"))


# --- one block of sorted conversations


def common_turns(a: bytes, b: bytes) -> int:
    """How many turns two conversations begin with alike."""
    n = min(len(a), len(b)) // DIGEST
    if a[: n * DIGEST] == b[: n * DIGEST]:
        return n
    low, high = 0, n - 1  # the first turn in which they differ
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if a[low * DIGEST : (middle + 1) * DIGEST] == b[low * DIGEST : (middle + 1) * DIGEST] else (low, middle)
    return low


class Segment:
    """Open nodes of depths lo to hi that begin at the same conversation l, with sums over l and what
    came after it in the block."""

    __slots__ = ("l", "lo", "hi", "n", "total", "own", "leaves", "least", "kids", "first", "before", "ends")

    def __init__(self, l: int, lo: int, conv: int, before: list[int], own: int, leaves: int) -> None:
        self.l, self.lo, self.hi, self.before = l, lo, len(before) - 1, before
        self.n, self.total, self.own, self.leaves, self.least, self.kids = 1, before[-1], own, leaves, conv, 0
        self.first, self.ends = (own, leaves), None

    def take(self, other: Segment) -> None:
        self.n += other.n
        self.total += other.total
        self.own += other.own
        self.leaves += other.leaves
        self.least = min(self.least, other.least)


def scan_block(rows: Iterable[tuple[int, bytes, list[int]]]) -> Iterator[dict]:
    """Pieces of nodes, runs of members and edges of a block of conversations (id, digests, lengths) in order.

    The common turns of neighbours (the LCP array) drive a stack of open nodes: a neighbour with m common
    turns closes all deeper than m. Nodes that the first conversation begins, and those open at the end,
    are `edge` pieces: blocks before and after may hold more of them. Of a node of depth d that begins at
    l a piece gives: n conversations, the total of their lengths, own (lengths of turns that a conversation
    doesn't share with the one before it, without those of l), leaves (conversations that end in a node of
    their own, less nodes so ended that go on; without l), least conv_id, kids (conversations after l that
    branch off at hi), before (lengths up to depth d - 1, for lo to hi).
    """
    stack: list[Segment] = []
    last, run, inner, index, count = b"", [], None, 0, 0
    first = first_before = None

    def piece(s: Segment, lo: int, parent: int, open_: bool) -> dict:
        return {
            "kind": PIECE, "l": s.l, "lo": lo, "hi": s.hi, "n": s.n, "total": s.total, "own": s.own - s.first[0], "leaves": s.leaves - s.first[1], "least": s.least, "kids": s.kids,
            "first_total": s.before[-1], "deep": len(s.before) - 1, "before": [s.before[d - 1] if d else 0 for d in range(lo, s.hi + 1)], "ends": s.ends, "parent_l": parent, "edge": open_ or not s.l,
        }

    def members(s: Segment) -> Iterator[dict]:
        for at in range(0, len(run), CHUNK):
            yield {"kind": MEMBERS, "l": s.l, "hi": len(s.before) - 1, "chunk": at // CHUNK, "ids": ",".join(map(str, run[at : at + CHUNK]))}

    for conv, digests, lengths in rows:
        count = len(digests) // DIGEST
        before = list(accumulate(lengths, initial=0))
        if not index:
            first, first_before, shared, own, leaves = digests, before, -1, 0, 0
        else:
            shared = common_turns(last, digests)
            inner = shared if inner is None else min(inner, shared)
            if shared == count:  # a copy
                run.append(conv)
                top = stack[-1]
                top.n, top.total, top.least, index = top.n + 1, top.total + before[-1], min(top.least, conv), index + 1
                continue
            if stack[-1].l:
                stack[-1].ends = hashlib.sha256(",".join(map(str, run)).encode()).hexdigest()
            else:
                yield from members(stack[-1])
            own, leaves = before[-1] - before[shared], 1 - (shared == len(last) // DIGEST)
            while stack[-1].lo > shared:
                s = stack.pop()
                yield piece(s, s.lo, stack[-1].l, False)
                stack[-1].take(s)
            s = stack[-1]
            if s.hi > shared:
                yield piece(s, shared + 1, s.l, False)
                s.hi, s.kids, s.ends = shared, 0, None
            s.kids += 1
        stack.append(Segment(index, shared + 1, conv, before, own, leaves))
        last, run, index = digests, [conv], index + 1
    if stack:
        yield from members(stack[-1])
        while stack:
            s = stack.pop()
            yield piece(s, s.lo, stack[-1].l if stack else -1, True)
            if stack:
                stack[-1].take(s)
        yield {"kind": EDGES, "first": first, "first_before": first_before, "last": last, "inner": inner}


def _scanned(sorted_rows: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "digests", "lengths")), strict=True)

        held: list[dict] = []
        for found in scan_block(rows()):
            held.append(found | {"block": block})
            if len(held) == 2000:
                yield pa.RecordBatch.from_pylist(held, schema=ARROW)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=ARROW)

    return sorted_rows.mapInArrow(scan, SCANNED)


# --- blocks together


class Blocks:
    """What scanned blocks know of each other: for the k-th block that holds rows, the turns its first
    conversation shares with the one before it, the smallest number that any in it shares with the one
    before, and for each block the nearest one before it with a smaller smallest number."""

    def __init__(self, numbers: list[int], shared: list[int], inner: list[int | None]) -> None:
        self.at = {b: k for k, b in enumerate(numbers)}
        self.numbers, self.shared = numbers, shared
        self.least = [s if i is None else min(s, i) for s, i in zip(shared, inner)]
        self.smaller = [-1] * len(numbers)
        for k in range(1, len(numbers)):
            x = k - 1
            while x >= 0 and self.least[x] >= self.least[k]:
                x = self.smaller[x]
            self.smaller[k] = x

    def owner(self, block: int, depth: int) -> int:
        """The block in which the node of this depth begins that the first conversation of `block` is in."""
        k = self.at[block]
        if depth > self.shared[k]:
            return block
        k -= 1
        while self.least[k] >= depth:
            k = self.smaller[k]
        return self.numbers[k]


def _edges(scanned: DataFrame) -> DataFrame:
    """A row for each block with rows: block, shared, inner, and of its first conversation: deep, own,
    leaves (as in scan_block)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                shared = common_turns(r["previous"], r["first"]) if r["previous"] is not None else -1
                deep, ended = len(r["first"]) // DIGEST, r["previous"] is not None and shared == len(r["previous"]) // DIGEST
                own = r["first_before"][-1] - r["first_before"][max(shared, 0)]
                out.append({"block": r["block"], "shared": shared, "inner": r["inner"], "deep": deep, "own": own, "leaves": int(shared < deep) - int(ended and deep > shared)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("block", pa.int32()), ("shared", pa.int32()), ("inner", pa.int32()), ("deep", pa.int32()), ("own", pa.int64()), ("leaves", pa.int64())]))

    rows = scanned.filter(F.col("kind") == EDGES).withColumn("previous", F.lag("last").over(W.orderBy("block")))  # as many rows as blocks
    return rows.select("block", "first", "first_before", "inner", "previous").mapInArrow(measure, "block int, shared int, inner int, deep int, own long, leaves long")


def _key(block: Column, l: Column, depth: Column) -> Column:
    """Name of a node: by the conversation it begins at, or (l null) of the node that the block begins and
    hands on."""
    return F.concat_ws(":", block.cast("string"), F.coalesce(l.cast("string"), F.lit("e")), depth.cast("string"))


def _owned(rows: DataFrame, blocks, depth: str, out: str) -> DataFrame:
    """rows with the block that owns the node of this depth at the beginning of the row's block."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if d is None else blocks.value.owner(b, d) for b, d in zip(batch.column("block").to_pylist(), batch.column(depth).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], schema=batch.schema.append(pa.field(out, pa.int32())))

    schema = ", ".join(f"{n} {kind}" for n, kind in rows.dtypes)
    return rows.mapInArrow(find, f"{schema}, {out} int")


def _member_hashes(members: DataFrame) -> DataFrame:
    """owner, depth, ended, ends: SHA-256 of the ids of a node's own members, whose chunks come from one
    block or several. A hash is made in one stream, chunk after chunk, and holds none of them."""

    def hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        row = lambda: pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, state.hexdigest())))], schema=schema)
        for batch in batches:
            for *now, ids in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "ended", "ids")), strict=True):
                if now != key:
                    if state:
                        yield row()
                    key, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if state:
            yield row()

    schema = pa.schema([("owner", pa.int32()), ("depth", pa.int32()), ("ended", pa.bool_()), ("ends", pa.string())])
    keys = ["owner", "depth", "ended"]
    dealt = members.repartition(*keys).sortWithinPartitions(*keys, "block", "chunk").select(*keys, "ids")
    return dealt.mapInArrow(hash_runs, "owner int, depth int, ended boolean, ends string")


def prefix_trie(convs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Nodes of the trie of convs (conv_id, digests, lengths; one row a conversation): conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node of depth d is a distinct sequence of d first turns; its members begin with it. conv_id is the
    smallest member, the parent is null for the root, n_leaves counts childless nodes below it or itself,
    saved_tokens sums (members - 1) times the length of the last text over the node and all below it,
    ends_sha256 is of the ids of the members that have no further turn, ascending, comma-joined.

    1. Conversations are sorted by their turns over range partitions (copies by conv_id too, so many
       copies are several tasks). A node is an interval of them.
    2. Each block (partition) is scanned once: common turns of neighbours, a stack of open nodes; nodes of
       the same interval stay one row. What reaches over a block's ends is given depth by depth.
    3. The smallest common turns of each block say, by nearest smaller values, in which block a node began
       that reaches into others; its pieces are summed by that block and depth.
    4. Parents' conv_ids are joined (a node with many children by broadcast), and depths expanded.

    The sum of saved_tokens over a subtree follows from sums over conversations: total lengths, less the
    lengths of turns that a conversation doesn't share with the one before it. The driver holds six
    numbers a block; a task holds the open nodes of one conversation, and of the ids of copies those in
    its block. No conversations, no nodes.
    """
    spark = convs.sparkSession
    dealt = convs.select("conv_id", "digests", "lengths").repartitionByRange(partitions or shuffle_partitions(spark), "digests", "conv_id").sortWithinPartitions("digests", "conv_id")
    scanned = materialize(_scanned(dealt))
    edges = materialize(_edges(scanned), 1)
    known = edges.select("block", "shared", "inner").orderBy("block").collect()
    blocks = spark.sparkContext.broadcast(Blocks([r["block"] for r in known], [r["shared"] for r in known], [r["inner"] for r in known]))

    pieces = scanned.filter(F.col("kind") == PIECE)
    # nodes inside blocks: their parents began in the block, or (parent_l 0) perhaps before it
    names = ["block", "l", "lo", "hi", "n", "total", "own", "leaves", "least", "kids", "first_total", "deep", "before", "ends", "parent_l"]
    inside = pieces.filter("not edge").select(*names, F.when(F.col("parent_l") == 0, F.col("lo") - 1).alias("asked"))
    inside = _owned(inside, blocks, "asked", "owner").withColumn("kids", F.col("kids") + (F.col("deep") > F.col("hi")).cast("long"))
    above = lambda owner, depth: _key(F.coalesce(owner, "block"), F.when(F.coalesce(owner == F.col("block"), F.lit(True)), F.col("parent_l")), depth)
    kept = ["lo", "hi", "n", "total", "own", "leaves", "least", "kids", "first_total", "before", "ends"]
    inside = inside.select(F.array(_key(F.col("block"), F.col("l"), F.col("hi"))).alias("keys"), *kept, above(F.col("owner"), F.col("lo") - 1).alias("parent"))

    # pieces over ends, by depth; those that begin a node say what it begins with
    by_depth = pieces.filter("edge").select(*names, F.posexplode("before").alias("up", "sofar")).withColumn("depth", F.col("lo") + F.col("up"))
    by_depth = by_depth.withColumns({"ends": F.when(F.col("depth") == F.col("hi"), F.col("ends")), "kids": F.when(F.col("depth") == F.col("hi"), F.col("kids")).otherwise(0), "parent_l": F.when(F.col("up") == 0, F.col("parent_l")).otherwise(F.col("l"))})
    by_depth = by_depth.withColumns({"asked": F.when(F.col("l") == 0, F.col("depth")), "above": F.when((F.col("parent_l") == 0) & (F.col("depth") > 0), F.col("depth") - 1)}).drop("before", "lo", "hi", "up")
    by_depth = _owned(_owned(by_depth, blocks, "asked", "owner"), blocks, "above", "parent_owner").withColumn("owner", F.coalesce("owner", "block"))
    begins = F.col("owner") == F.col("block")
    firsts = edges.select("block", *(F.col(c).alias(f"f_{c}") for c in ("shared", "inner", "deep", "own", "leaves")))
    # begun by the block's first conversation and ended inside the block: no node that goes on
    ended = (F.coalesce((F.col("l") == 0) & begins & (F.col("f_inner") < F.col("depth")), F.lit(False))).alias("ended")
    by_depth = by_depth.join(firsts, "block").select("*", ended)
    more = lambda value, first: F.sum(F.col(value) + F.when(begins, 0).otherwise(first))
    of_first = lambda c: F.max(F.when(begins, c))
    merged = by_depth.groupBy("owner", "depth", "ended").agg(
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        more("own", F.col("f_own")).alias("own"),
        more("leaves", F.col("f_leaves")).alias("leaves"),
        F.min("least").alias("least"),
        F.sum(F.col("kids") + F.when(begins, F.col("deep") > F.col("depth")).otherwise((F.col("f_shared") == F.col("depth")) & (F.col("f_deep") > F.col("depth"))).cast("long")).alias("kids"),
        of_first(F.col("first_total")).alias("first_total"),
        of_first(F.col("sofar")).alias("sofar"),
        of_first(F.col("ends")).alias("known_ends"),
        of_first(F.col("l")).alias("l"),
        of_first(F.when(F.col("depth") > 0, above(F.col("parent_owner"), F.col("depth") - 1))).alias("parent"),
    )
    # a run of members that the block begins with may go on from blocks before it
    runs = scanned.filter(F.col("kind") == MEMBERS).select("block", "l", F.col("hi").alias("depth"), "chunk", "ids", F.when(F.col("l") == 0, F.col("hi")).alias("asked"))
    runs = _owned(runs, blocks, "asked", "owner").withColumn("owner", F.coalesce("owner", "block")).join(firsts, "block").select("block", "owner", "depth", ended, "chunk", "ids")
    merged = merged.join(_member_hashes(runs), ["owner", "depth", "ended"], "left")
    keys = F.array_compact(F.array(F.when(~F.col("ended"), _key(F.col("owner"), F.lit(None), F.col("depth"))), _key(F.col("owner"), F.col("l"), F.col("depth"))))
    edge_nodes = merged.select(
        keys.alias("keys"), F.col("depth").alias("lo"), F.col("depth").alias("hi"), "n", "total", "own", "leaves", "least", "kids", "first_total", F.array("sofar").alias("before"), F.coalesce("known_ends", "ends").alias("ends"), "parent"
    )
    nodes = materialize(inside.unionByName(edge_nodes))

    asked = nodes.filter("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("askers"))
    parents = materialize(nodes.select(F.explode("keys").alias("parent"), F.col("least").alias("parent_least")).join(asked, "parent"))
    placed = join_counted(nodes, parents, "parent", "askers", asked.agg(F.sum("askers")).first()[0] or 0, "left")
    each = placed.select("*", F.posexplode("before").alias("up", "sofar")).withColumn("depth", F.col("lo") + F.col("up"))
    lowest = F.col("depth") == F.col("hi")
    return each.select(
        F.col("least").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.when(F.col("up") > 0, F.col("least")).otherwise(F.col("parent_least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(lowest, F.col("kids")).otherwise(F.lit(1).cast("long")).alias("n_children"),
        (F.col("leaves") + 1).alias("n_leaves"),
        (F.col("total") - F.col("own") - F.col("first_total") - (F.col("n") - 1) * F.col("sofar")).alias("saved_tokens"),
        F.coalesce(F.when(lowest, F.col("ends")), F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


def conversation_trie(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """prefix_trie of the conversations in turns (conv_id, turn, role, text) as they are."""
    return prefix_trie(conversations(turns), partitions)


def shared_start_trie(turns: DataFrame, every: int = 100, most: int = 6, partitions: int | None = None) -> DataFrame:
    """prefix_trie of the conversations after with_shared_starts, with crc32(conv_id as text) % most turns
    from conversation conv_id - conv_id % every."""
    convs = materialize(conversations(turns))
    count = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    return prefix_trie(with_shared_starts(convs, every, most, count), partitions)
