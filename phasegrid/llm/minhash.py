"""Near-duplicates by min-max hashing: each permutation of the shingles gives its least and its greatest value.

Equal shingle sets form a class first. Classes that share a band of the signature are candidates; each
is held against the least class of every bucket, on full sets. Where that leaves a group of candidates in several components,
all its pairs across components are held too, in blocks, so no link among candidates is lost.

Sets of up to 14 shingles are also filed under what is left of them without one or two shingles, as many as
a link at 0.8 may cost them: two such sets that are linked always meet. Of a pair with 15 or more shingles together that is at 0.8
exactly, 44 bands of 6 values miss about one case of 290,000 (15 shingles) to 600,000 (many); closer pairs far less.

Defined cases: null and empty texts have no shingles and no links; texts with fewer words than a shingle have one;
repeated rows are copies; rows that share a doc_id but not the text are nodes of their own; rows without a doc_id take part,
and their component_id is null unless a row they are linked with has one; an empty table gives no rows; columns with other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, beside, buffers, compact, cut, free_name, hashed, lowered, mix, slices, text_of, with_groups, words
from .graph import components

BANDS, PAIRS = 44, 3
#: Classes of a group of candidates that one task holds against as many others.
BLOCK = 512
#: Sets of up to SMALL shingles are filed under their parts; those below LEAST_BANDS only so, as no partner of theirs is larger than SMALL.
SMALL, LEAST_BANDS = 14, 12
_SEEDS = np.random.default_rng(99).integers(1, 1 << 63, (BANDS * PAIRS, 2), dtype=np.uint64)


def shingles(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of every row (with repeats), and the bounds of each row's among them."""
    data = lowered(data)
    starts, ends, first = words(data, bounds)
    n = np.diff(first)
    word = hashed(data, starts, ends)
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    at = np.r_[0, np.cumsum(counts)]
    begin = np.repeat(first[:-1] - at[:-1], counts) + np.arange(at[-1])
    length = np.repeat(np.minimum(n, k), counts)
    out = mix(length.astype(np.uint64) + np.uint64(11))
    for j in range(k):
        use = length > j
        out = np.where(use, mix(out + word[np.minimum(begin + j, len(word) - 1)]), out) if len(word) else out
    return out, at


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values once, sorted by row and value, and their bounds."""
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    fresh = np.r_[True, (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])] if len(values) else np.zeros(0, bool)
    return values[fresh], np.r_[0, np.cumsum(np.bincount(rows[fresh], minlength=len(bounds) - 1))]


def set_marks(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of different values of each row, and two hashes of that set."""
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    both = mix(values ^ mix(rows.astype(np.uint64) + np.uint64(0xABCD)))
    at = np.sort(np.unique(both, return_index=True)[1])
    values, n = values[at], np.bincount(rows[at], minlength=len(bounds) - 1)
    edge = np.r_[0, np.cumsum(n)]
    marks = []
    for seed in (3, 5):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values + np.uint64(seed)), out=total[1:])
        marks.append(total[edge[1:]] - total[edge[:-1]])
    return n, *marks


def band_keys(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Matrix[row, band] of bucket keys; rows must not be empty."""
    out = np.empty((len(bounds) - 1, BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(bounds) - 1, band, np.uint64)
        for a, b in _SEEDS[band * PAIRS : (band + 1) * PAIRS]:
            moved = values * (a | np.uint64(1)) + b
            key = mix(mix(key + np.minimum.reduceat(moved, bounds[:-1])) + np.maximum.reduceat(moved, bounds[:-1]))
        out[:, band] = key
    return out


def part_keys(values: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): each set (values distinct) without up to as many items as it can lack in a set it is linked with."""
    n = np.diff(bounds)
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for size in np.unique(n[n > 0]).tolist():
        of = np.flatnonzero(n == size)
        items = mix(values[bounds[:-1][of][:, None] + np.arange(size)] + np.uint64(0x5851F42D))
        total = items.sum(1, dtype=np.uint64)
        for less in range((100 - percent) * size // 100 + 1):
            for gone in combinations(range(size), less):
                rows.append(of)
                keys.append(mix(total - items[:, list(gone)].sum(1, dtype=np.uint64) + np.uint64(size - less)))
    return np.concatenate(rows), np.concatenate(keys)


SIGNED = "doc_id long, nid long, n long, mark1 long, mark2 long, bands array<long>"


def _sign(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                values, bounds = shingles(*buffers(batch.column("_text")), k)
                n, one, two = set_marks(values, bounds)
                of, keys = [], []
                if len(full := np.flatnonzero(n >= LEAST_BANDS)):
                    # Rows with fewer shingles lie between these, so each takes its own run of values.
                    many = np.diff(bounds)[full]
                    at = np.r_[0, np.cumsum(many)]
                    own = values[np.repeat(bounds[:-1][full] - at[:-1], many) + np.arange(at[-1])]
                    of.append(np.repeat(full, BANDS))
                    keys.append(band_keys(own, at).ravel())
                if len(few := np.flatnonzero((n > 0) & (n <= SMALL))):
                    many = np.diff(bounds)[few]
                    at = np.r_[0, np.cumsum(many)]
                    own = values[np.repeat(bounds[:-1][few] - at[:-1], many) + np.arange(at[-1])]
                    row, key = part_keys(*distinct(own, at), percent)
                    of.append(few[row])
                    keys.append(key)
                of, keys = (np.concatenate(of), np.concatenate(keys)) if of else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
                ends = np.r_[0, np.cumsum(np.bincount(of, minlength=len(n)))].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[np.argsort(of, kind="stable")].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("nid"), pa.array(n.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists], names=[x.split()[0] for x in SIGNED.split(", ")])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                values, bounds = distinct(*shingles(*buffers(batch.column("_text")), k))
                yield pa.RecordBatch.from_arrays([batch.column("nid"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))], names=["nid", "items"])

    return run


def linked(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of a, which sets of b have 100 * intersection >= percent * union. Items of a set are distinct."""
    sizes = np.array([len(x) for x in b], np.int64)
    items, of = np.concatenate(b), np.repeat(np.arange(len(b)), sizes)
    order = np.argsort(items, kind="stable")
    items, of = items[order], of[order]
    for i, x in enumerate(a):
        lo, hi = np.searchsorted(items, x, "left"), np.searchsorted(items, x, "right")
        n = hi - lo
        if not n.sum():
            continue
        at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        common = np.bincount(of[at], minlength=len(b))
        yield i, np.flatnonzero(100 * common >= percent * (len(x) + sizes - common))


def _across(percent: int):
    """Links between the two blocks of a group, as few as join what they join."""

    def run(rows: pa.Table) -> pa.Table:
        side = rows["side"].to_numpy()
        left, right = rows.filter(pa.array(side == 0)), rows.filter(pa.array(side == 1))
        found: list[tuple[int, int]] = []
        if left.num_rows and right.num_rows:
            sets = [[np.asarray(x.values) for x in t["items"]] for t in (left, right)]
            ids = [t["nid"].to_pylist() for t in (left, right)]
            roots = [t["root"].to_pylist() for t in (left, right)]
            up: dict[int, int] = {}

            def top(x: int) -> int:
                while up.get(x, x) != x:
                    up[x] = up.get(up[x], up[x])
                    x = up[x]
                return x

            for i, js in linked(*sets, percent):
                for j in js.tolist():
                    p, q = top(roots[0][i]), top(roots[1][j])
                    if p != q:
                        up[max(p, q)] = min(p, q)
                        found.append((ids[0][i], ids[1][j]))
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return run


def links(docs: DataFrame, signed: DataFrame, k: int, percent: int, block: int | None = None) -> DataFrame:
    """(node, root) over classes that are linked with others. docs: nid, _text."""
    block = block or BLOCK
    classes = signed.where("n > 0").groupBy("mark1", "mark2", "n").agg(F.min(F.struct("nid", "bands")).alias("one")).select("one.nid", F.explode("one.bands").alias("key"))
    classes = cut(classes)
    met = with_groups(classes, ["key"], F.xxhash64("nid"), {"hub": F.min("nid"), "c": F.count("*")}, {"hub": F.min("hub"), "c": F.sum("c")}, "c > 1")
    pairs = cut(met.where("nid <> hub").select("nid", "hub").distinct())
    n_pairs = pairs.count()
    if not n_pairs:
        return pairs.select(F.col("nid").alias("node"), F.col("hub").alias("root"))
    pairs = compact(pairs, n_pairs)
    groups = components(pairs.select(F.col("nid").alias("a"), F.col("hub").alias("b")))
    members = groups.select(F.col("node").alias("nid"))
    sets = cut(docs.join(members, "nid", "left_semi").select("nid", "_text").dropDuplicates(["nid"]).mapInArrow(_sets(k), "nid long, items array<long>"))
    sets = compact(sets, n_pairs, 2000)
    held = beside(pairs.join(sets, "nid"), sets.select(F.col("nid").alias("hub"), F.col("items").alias("others")), "hub", F.xxhash64("nid"))
    common = F.size(F.array_intersect("items", "others"))
    near = held.where(100 * common >= percent * (F.size("items") + F.size("others") - common)).select(F.col("nid").alias("a"), F.col("hub").alias("b"))
    near = compact(cut(near), n_pairs)
    first = components(near).withColumnRenamed("node", "nid")
    # Groups of three or more that the links with hubs leave apart.
    state = compact(cut(groups.select(F.col("node").alias("nid"), F.col("root").alias("grp")).join(first, "nid", "left").withColumn("root", F.coalesce("root", "nid"))), n_pairs)
    sizes = state.groupBy("grp", "root").agg(F.count("*").alias("c"))
    apart = sizes.groupBy("grp").agg(F.sum("c").alias("total"), F.count("*").alias("parts"), F.max(F.struct("c", "root")).alias("most")).where("parts > 1 and total > 2")
    # Rows of a group are spread over blocks by hash; the core, its largest part, only meets the rest.
    split = lambda c: F.ceil(c / block).cast("int")
    apart = cut(apart.select("grp", F.col("most.root").alias("core"), split(F.col("total") - F.col("most.c")).alias("r"), split(F.col("most.c")).alias("c")))
    if apart.isEmpty():
        return first.withColumnRenamed("nid", "node")
    placed = beside(state, apart, "grp", F.xxhash64("nid")).withColumn("rest", F.col("root") != F.col("core"))
    placed = placed.withColumn("at", F.pmod(F.xxhash64("nid"), F.when(F.col("rest"), F.col("r")).otherwise(F.col("c"))).cast("int"))
    # Block i of the rest meets blocks of the rest from i on (right side), and all blocks of the core (numbered after them).
    as_left = placed.where("rest").select("nid", "grp", "root", F.lit(0).alias("side"), F.col("at").alias("i"), F.explode(F.expr("sequence(at, r + c - 1)")).alias("j"))
    rest_right = placed.where("rest").select("nid", "grp", "root", F.lit(1).alias("side"), F.explode(F.expr("sequence(0, at)")).alias("i"), F.col("at").alias("j"))
    core_right = placed.where("not rest").select("nid", "grp", "root", F.lit(1).alias("side"), F.explode(F.expr("sequence(0, r - 1)")).alias("i"), (F.col("r") + F.col("at")).alias("j"))
    blocks = as_left.unionByName(rest_right).unionByName(core_right).join(sets, "nid")
    more = compact(cut(blocks.groupBy("grp", "i", "j").applyInArrow(_across(percent), "a long, b long")), n_pairs)
    return first.withColumnRenamed("nid", "node") if more.isEmpty() else components(first.select(F.col("nid").alias("a"), F.col("root").alias("b")).unionByName(more))


def _members(docs: DataFrame, k: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, nid, component_id, keeper): nid stands for a row's doc_id and text; keeper is that of the row that stays for its component."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _node(doc_id, text).alias("nid"), text_of(text).cast("binary").alias("_text"))
    signed = cut(base.mapInArrow(_sign(k, percent), SIGNED))
    roots = links(base.select("nid", "_text"), signed, k, percent)
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "nid")
    classes = signed.where("n > 0").groupBy("mark1", "mark2", "n").agg(F.min("nid").alias("first"), F.min(own).alias("least"))
    classes = cut(classes.join(roots, F.col("first") == F.col("node"), "left").drop("node"))
    # The least row of each component of several classes.
    joint = classes.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("least").alias("joint"))
    classes = classes.join(joint, "root", "left").select("mark1", "mark2", "n", F.coalesce("joint", "least").alias("least"))
    rows = beside_class(signed.drop("bands"), classes)
    alone = F.col("n") == 0
    return rows.select("doc_id", "n", "nid", F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"), F.when(~alone, F.col("least.nid")).alias("keeper"))


def beside_class(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows with the columns of their class, null for rows without shingles; copies of one text are dealt over several tasks."""
    key = F.struct("mark1", "mark2", "n").alias("class")
    full = beside(signed.where("n > 0").select(key, "doc_id", "nid"), classes.select(key, "least"), "class", F.xxhash64("nid")).select("doc_id", "nid", F.col("class.n").alias("n"), "least")
    return full.unionByName(signed.where("n = 0").select("doc_id", "nid", "n"), allowMissingColumns=True)


def _node(doc_id: str, text: str):
    return F.xxhash64(F.col(doc_id).cast("long"), text_of(text))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of docs."""
    rows = _members(docs, k, percent, doc_id, text)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stay: one of each component, that with the least doc_id, and every row without words.

    Rows that share a doc_id but not the text only go if their text has a near-copy. Null ids come last. Columns may have any names.
    """
    node, once = free_name(docs, "_node"), free_name(docs, "_once")
    rows = _members(docs, k, percent, doc_id, text)
    gone = rows.where("nid <> keeper").select(F.col("nid").alias(node)).distinct()
    # Rows without words are never copies; they keep a number of their own.
    wordless = ~text_of(text).rlike(WORD)
    marked = docs.withColumn(node, _node(doc_id, text)).withColumn(once, F.when(wordless, F.monotonically_increasing_id()))
    return marked.join(gone, node, "left_anti").dropDuplicates([node, once]).select(*(F.col(f"`{c}`") for c in docs.columns))
