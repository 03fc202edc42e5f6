"""Prefix trie of conversations with subtree totals by time-forward processing.

A node is a distinct beginning of conversations. It is named by its depth and the smallest id among its members; a conversation has
one node at each depth, so that name is unique and a member's path gives all ancestors.

Prefixes. Turns are sorted once over all conversations; a prefix is a polynomial in 124-bit digests of its turns modulo the prime
2**127 - 1. Such states join, so a conversation may span tasks: a task gives local states, and one row of each task (its last) tells
what the next one has to add. Nothing holds a whole conversation.

Totals. Nodes are dealt into shards: a node with more than `heavy` members is a shard of its own, any other belongs to the shard of its
nearest ancestor below a heavy node or at a depth divisible by `band`. Within a shard nodes are sorted by reverse level order (Spark's
sort, which spills), and each passes its totals to its parent through a priority queue that spills runs to Spark's local folders and
deletes them. Then the shard roots pass theirs on: shards without shards below them in an aggregate by target, the others (at most one
for `heavy` or for `band` turn rows, so a small share of the input) by the same pass over the tree of shards. Last, only shards that
hold targets are passed again with what came in.

Defined cases: turns are ordered by turn (null first), then role, then text; null roles and texts are empty; repeated rows are turns of
their own; rows without a conversation id are left out; conversations without turns end at the root; an empty table gives no rows, so no
root; columns with other names are ignored. Negative ids keep the sign of the remainder that Spark's % gives.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, cut, parallelism, with_groups

_PRIME = (1 << 127) - 1
_BASE = int.from_bytes(hashlib.sha256(b"prefix states").digest()[:15], "big")


@dataclass(frozen=True)
class Shape:
    """Members beyond which a node is a shard of its own, depths that a shard spans, and queue entries that a task keeps in memory."""

    heavy: int = 64
    band: int = 256
    queue: int = 200_000


class SpillingQueue:
    """A priority queue with `most` entries in memory; the rest lies in sorted runs on disk, which are deleted when closed."""

    def __init__(self, most: int):
        self.most, self.heap, self.runs, self.files = most, [], [], []

    def push(self, entry: tuple) -> None:
        heapq.heappush(self.heap, entry)
        if len(self.heap) > self.most:
            self._spill()

    def _spill(self) -> None:
        folder = (os.environ.get("SPARK_LOCAL_DIRS") or os.environ.get("SPARK_LOCAL_DIR") or "").split(",")[0]
        file = tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)
        self.heap.sort()
        keep = self.heap[: self.most // 2]
        for at in range(len(keep), len(self.heap), 512):
            pickle.dump(self.heap[at : at + 512], file)
        self.heap = keep
        file.seek(0)
        self.files.append(file)
        self._next(_unpickled(file))

    def _next(self, run: Iterator[tuple]) -> None:
        first = next(run, None)
        if first is not None:
            heapq.heappush(self.runs, (first, len(self.files), id(run), run))

    def least(self) -> tuple | None:
        a = self.heap[0] if self.heap else None
        b = self.runs[0][0] if self.runs else None
        return b if a is None or (b is not None and b < a) else a

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            entry, *_, run = heapq.heappop(self.runs)
            self._next(run)
            return entry
        return heapq.heappop(self.heap)

    def close(self) -> None:
        for file in self.files:
            file.close()


def _unpickled(file) -> Iterator[tuple]:
    at = 0
    while True:  # runs of one file are read in turn with others, so the place is kept
        file.seek(at)
        try:
            entries = pickle.load(file)
        except EOFError:
            return
        at = file.tell()
        yield from entries


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], names=schema.names)


def _wide(x: int) -> bytes:
    return x.to_bytes(16, "big")


# ---- states of prefixes ----


def prefix_states(turns: DataFrame) -> DataFrame:
    """(conv, place, state, chars): of each turn its place from 1, the state of the prefix that it ends, and its code points."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    clean = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text"))
    by = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    placed = clean.repartitionByRange(parallelism(turns.sparkSession), *by).sortWithinPartitions(*by)
    mark = F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256), 1, 31)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def walk() -> Iterator[tuple]:
            first = before = None
            place = state = 0
            row = None
            for part, conv, mark, chars in _rows(batches):
                if row is not None:
                    yield (*row, False)
                if conv != before:
                    place, state = 0, 0
                first = conv if before is None else first
                before, place, state = conv, place + 1, (state * _BASE + int(mark, 16) + 1) % _PRIME
                row = (part, conv, place, _wide(state), chars, conv == first)
            if row is not None:
                yield (*row, True)

        yield from _batches(walk(), pa.schema([("part", pa.int32()), ("conv", pa.int64()), ("place", pa.int64()), ("state", pa.binary()), ("chars", pa.int64()), ("early", pa.bool_()), ("last", pa.bool_())]))

    kept = cut(placed.select(F.spark_partition_id().alias("part"), "conv", mark.alias("mark"), F.length("text").cast("long").alias("chars")).mapInArrow(local, "part int, conv long, place long, state binary, chars long, early boolean, last boolean"))
    carried: dict[int, tuple[int, int, int]] = {}
    before: tuple[int, int, int] | None = None
    for x in sorted(kept.where("last").select("part", "conv", "place", "state", "early").collect()):  # one row of each task
        place, state = x.place, int.from_bytes(x.state, "big")
        if before is not None:
            carried[x.part] = before
            if x.early and x.conv == before[0]:
                place, state = before[1] + place, (before[2] * pow(_BASE, place, _PRIME) + state) % _PRIME
        before = (x.conv, place, state)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def walk() -> Iterator[tuple]:
            for part, conv, place, state, chars, early in _rows(batches):
                if early and part in carried and carried[part][0] == conv:
                    _, more, start = carried[part]
                    state = _wide((start * pow(_BASE, place, _PRIME) + int.from_bytes(state, "big")) % _PRIME)
                    place += more
                yield conv, place, state, chars

        yield from _batches(walk(), pa.schema([("conv", pa.int64()), ("place", pa.int64()), ("state", pa.binary()), ("chars", pa.int64())]))

    return kept.select("part", "conv", "place", "state", "chars", "early").mapInArrow(whole, "conv long, place long, state binary, chars long")


def whole_paths(turns: DataFrame) -> DataFrame:
    """Paths of the conversations as they are: see borrowed_heads."""
    return borrowed_heads(turns, F.col("conv_id"), F.lit(0), most=0)


def borrowed_heads(turns: DataFrame, base: Column, h: Column, most: int) -> DataFrame:
    """(conv, depth, key, chars, ends): the prefixes of conversations whose first h turns (`most` at most) are replaced by those of conversation `base`.

    base and h are columns of conv_id. A row of depth 0 stands for the empty beginning; `ends` marks the whole conversation.
    """
    states = prefix_states(turns)
    early = F.when(F.col("place") <= most, F.struct("place", "state", "chars"))
    convs = states.groupBy("conv").agg(F.max("place").alias("n"), F.sort_array(F.collect_list(early)).alias("heads")).withColumn("conv_id", F.col("conv"))
    convs = cut(convs.withColumn("base", base).withColumn("h", F.least(h.cast("int"), F.lit(most))).drop("conv_id"))
    lent = convs.select(F.col("conv").alias("base"), F.col("heads").alias("lent"))
    convs = convs.join(lent, "base", "left").withColumn("lent", F.slice(F.coalesce("lent", F.array().cast("array<struct<place:bigint,state:binary,chars:bigint>>")), 1, F.col("h")))
    convs = convs.withColumn("rest", F.greatest(F.col("n") - F.col("h"), F.lit(0)).cast("long")).withColumn("size", F.size("lent") + F.col("rest"))
    start = F.array(F.struct(F.lit(0).cast("long").alias("place"), F.lit(bytes(16)).alias("state"), F.lit(0).cast("long").alias("chars")))
    heads = convs.select("conv", "size", F.explode(F.concat(start, "lent")).alias("t")).select("conv", F.col("t.place").alias("depth"), F.col("t.state").alias("key"), F.col("t.chars").alias("chars"), (F.col("t.place") == F.col("size")).alias("ends"))
    zero = F.lit(bytes(16))
    late = convs.where("rest > 0").select("conv", "h", "size", F.size("lent").alias("own"), F.when(F.size("lent") > 0, F.try_element_at("lent", F.lit(-1))["state"]).otherwise(zero).alias("new"), F.when(F.col("h") > 0, F.try_element_at(F.slice("heads", 1, F.greatest("h", F.lit(1))), F.lit(-1))["state"]).otherwise(zero).alias("old"))
    own = beside(states, late, "conv", F.col("place")).where("place > h")

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def walk() -> Iterator[tuple]:
            power, at = 1, 0
            for conv, place, state, chars, h, size, head, new, old in _rows(batches):
                steps = place - h
                if new != old:
                    power = power * _BASE % _PRIME if steps == at + 1 else pow(_BASE, steps, _PRIME)
                    at = steps
                    state = _wide((int.from_bytes(state, "big") + (int.from_bytes(new, "big") - int.from_bytes(old, "big")) * power) % _PRIME)
                depth = head + steps
                yield conv, depth, state, chars, depth == size

        yield from _batches(walk(), pa.schema([("conv", pa.int64()), ("depth", pa.int64()), ("key", pa.binary()), ("chars", pa.int64()), ("ends", pa.bool_())]))

    moved = own.select("conv", "place", "state", "chars", "h", "size", "own", "new", "old").mapInArrow(move, "conv long, depth long, key binary, chars long, ends boolean")
    return heads.unionByName(moved)


# ---- totals of subtrees ----

_TOTALS = "shard_depth long, shard_conv long, depth long, conv long, parent long, n_convs long, n_children long, n_leaves long, saved long"


def time_forward(nodes: DataFrame, queue: int) -> DataFrame:
    """nodes (_TOTALS) with totals of their subtrees inside their shard: each hands its own to its parent, deepest first.

    n_leaves, saved and n_children come in with a node's own share. Rows of a shard must reach one task together.
    """
    names = [x.split()[0] for x in _TOTALS.split(", ")]
    near = nodes.select(*names).repartition("shard_depth", "shard_conv").sortWithinPartitions("shard_depth", "shard_conv", F.desc("depth"), "conv")

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def walk() -> Iterator[tuple]:
            inbox, shard = SpillingQueue(queue), None
            try:
                for top, root, depth, conv, parent, n_convs, children, leaves, saved in _rows(batches):
                    if (top, root) != shard:
                        shard = (top, root)
                    while (entry := inbox.least()) is not None and entry[:2] == (-depth, conv):
                        inbox.pop()
                        children, leaves, saved = children + entry[2], leaves + entry[3], saved + entry[4]
                    yield top, root, depth, conv, parent, n_convs, children, leaves, saved
                    if depth > top:
                        inbox.push((1 - depth, parent, 1, leaves, saved))
            finally:
                inbox.close()

        yield from _batches(walk(), pa.schema([(n, pa.int64()) for n in names]))

    return near.mapInArrow(forward, _TOTALS)


def members_digest(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256): digest of the ids (conv) of each node (depth, node), ascending, joined by commas.

    A digest reads its input in order, so many ids are first joined to long strings, side by side; then one task reads the strings of a node.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def walk() -> Iterator[tuple]:
            name, held, size, first = None, [], 0, 0
            for depth, node, conv in _rows(batches):
                if (depth, node) != name or size > 1 << 15:
                    if held:
                        yield (*name, first, ",".join(held))
                    name, held, size, first = (depth, node), [], 0, conv
                held.append(str(conv))
                size += len(held[-1]) + 1
            if held:
                yield (*name, first, ",".join(held))

        yield from _batches(walk(), pa.schema([("depth", pa.int64()), ("node", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]), 256)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def walk() -> Iterator[tuple]:
            name, state = None, None
            for depth, node, _, ids in _rows(batches):
                if (depth, node) != name:
                    if name is not None:
                        yield (*name, state.hexdigest())
                    name, state = (depth, node), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if name is not None:
                yield (*name, state.hexdigest())

        yield from _batches(walk(), pa.schema([("depth", pa.int64()), ("node", pa.int64()), ("ends_sha256", pa.string())]))

    by = ["depth", "node", "conv"]
    parts = ends.select(*by).repartitionByRange(parallelism(ends.sparkSession), *by).sortWithinPartitions(*by).mapInArrow(join, "depth long, node long, first long, ids string")
    return parts.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(digest, "depth long, node long, ends_sha256 string")


def trie_nodes(paths: DataFrame, shape: Shape) -> tuple[DataFrame, DataFrame]:
    """The nodes (_TOTALS, own shares only), and (depth, node, conv) of every conversation that ends at a node."""
    each = {"_n": F.count(F.lit(1)), "_least": F.min("conv"), "_ends": F.sum(F.col("ends").cast("long"))}
    joint = {"n_convs": F.sum("_n"), "node": F.min("_least"), "n_ends": F.sum("_ends")}
    rows = cut(with_groups(paths, ["depth", "key"], F.xxhash64("conv"), each, joint).drop("key"))
    ends = rows.where("ends").select("depth", "node", "conv")
    above = rows.select("conv", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    nodes = rows.where("conv = node").join(above, ["conv", "depth"], "left")
    # Heavy nodes are the upper part of a path: below them and at each band a shard begins.
    upper = rows.groupBy("conv").agg(F.max(F.when(F.col("n_convs") > shape.heavy, F.col("depth"))).alias("upper"))
    nodes = beside(nodes, upper, "conv", F.col("depth"))
    shard_depth = F.when(F.col("n_convs") > shape.heavy, F.col("depth")).otherwise(F.greatest(F.coalesce(F.col("upper") + 1, F.lit(0)), F.floor(F.col("depth") / shape.band) * shape.band))
    roots = rows.select("conv", F.col("depth").alias("shard_depth"), F.col("node").alias("shard_conv"))
    nodes = nodes.withColumn("shard_depth", shard_depth.cast("long")).join(roots, ["conv", "shard_depth"])
    leaf = F.col("n_convs") == F.col("n_ends")  # nobody goes on
    saved = (F.col("n_convs") - 1) * F.col("chars")
    return nodes.select("shard_depth", "shard_conv", "depth", "conv", "parent", "n_convs", F.lit(0).cast("long").alias("n_children"), leaf.cast("long").alias("n_leaves"), saved.cast("long").alias("saved")), ends


def subtree_totals(nodes: DataFrame, shape: Shape) -> DataFrame:
    """nodes (_TOTALS, own shares) with the totals of their whole subtrees."""
    own = cut(nodes)
    inside = cut(time_forward(own, shape.queue))
    # Each shard root sends to its parent, which lies in another shard.
    of, to = ["shard_depth", "shard_conv"], ["to_depth", "to_conv"]
    messages = inside.where("depth = shard_depth and conv = shard_conv and depth > 0").select(*of, (F.col("depth") - 1).alias("to_depth"), F.col("parent").alias("to_conv"), "n_leaves", "saved")
    homes = own.select(F.col("depth").alias("to_depth"), F.col("conv").alias("to_conv"), *(F.col(c).alias(f"to_{c}") for c in of))
    homes = cut(messages.select(*to).distinct().join(homes, to))
    inner = cut(homes.select(*(F.col(f"to_{c}").alias(c) for c in of)).distinct())
    total = [F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")]
    outer = messages.join(inner, of, "left_anti").groupBy(*to).agg(*total)
    # Shards that have shards below form a tree; a shard's total is that of its root.
    came = outer.join(homes, to).groupBy(*(F.col(f"to_{c}").alias(c) for c in of)).agg(F.sum("n_leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    tops = inside.where("depth = shard_depth and conv = shard_conv").join(inner, of).select(*of, (F.col("depth") - 1).alias("to_depth"), F.col("parent").alias("to_conv"), "n_leaves", "saved")
    more = {c: (F.col(c) + F.coalesce(f"_{c.split('_')[-1]}", F.lit(0))).alias(c) for c in ("n_leaves", "saved")}
    tree = tops.join(came, of, "left").join(homes, to, "left").select(*of, *(f"to_{c}" for c in of), *more.values())
    inward = messages.drop("n_leaves", "saved").join(_shard_tree(tree, shape.queue), of).groupBy(*to).agg(*total)
    extra = outer.unionByName(inward).groupBy(F.col("to_depth").alias("depth"), F.col("to_conv").alias("conv")).agg(*(F.sum(c).alias(f"_{c}") for c in ("n_children", "n_leaves", "saved")))
    again = own.join(inner, of).join(extra, ["depth", "conv"], "left")
    for c in ("n_children", "n_leaves", "saved"):
        again = again.withColumn(c, F.col(c) + F.coalesce(f"_{c}", F.lit(0)))
    return inside.join(inner, of, "left_anti").unionByName(time_forward(again, shape.queue))


def _shard_tree(tree: DataFrame, queue: int) -> DataFrame:
    """(shard_depth, shard_conv, n_leaves, saved): totals of the shards of a tree, by one pass over its few rows."""

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def walk() -> Iterator[tuple]:
            inbox = SpillingQueue(queue)
            try:
                for depth, conv, up_depth, up_conv, leaves, saved in _rows(batches):
                    while (entry := inbox.least()) is not None and entry[:2] == (-depth, conv):
                        inbox.pop()
                        leaves, saved = leaves + entry[2], saved + entry[3]
                    yield depth, conv, leaves, saved
                    if up_depth is not None:
                        inbox.push((-up_depth, up_conv, leaves, saved))
            finally:
                inbox.close()

        yield from _batches(walk(), pa.schema([(n, pa.int64()) for n in ("shard_depth", "shard_conv", "n_leaves", "saved")]))

    return tree.repartition(1).sortWithinPartitions(F.desc("shard_depth"), "shard_conv").mapInArrow(forward, "shard_depth long, shard_conv long, n_leaves long, saved long")


def prefix_trie(paths: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """One row per node of the trie of `paths` (whole_paths or borrowed_heads).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), where conv_id is a node's smallest member.
    """
    nodes, ends = trie_nodes(paths, shape)
    totals = subtree_totals(nodes, shape)
    digests = members_digest(ends).withColumnRenamed("node", "conv")
    none = hashlib.sha256(b"").hexdigest()
    out = totals.join(digests, ["depth", "conv"], "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
