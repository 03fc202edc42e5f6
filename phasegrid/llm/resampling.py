"""Importance resampling towards a target corpus: hashed n-gram gains and a Gumbel draw without replacement.

Two passes over the documents. The first counts how often each bucket's n-grams occur, the second gives a document the mean gain of
its n-grams. Inside a task the n-grams of a batch are interned in an open-addressed numpy table: 64-bit xxHash keys find a slot, the
bytes are compared before a slot is shared, slots keep their bucket and their count, and each occurrence its slot. So a bucket is
worked out once for each distinct n-gram of a batch. Between tasks go only counts by bucket (at most `buckets` rows from each task)
and the list of gains.

Defined cases: null and empty texts, and those without words, have no features, weight 0 and no rank; repeated rows are counted and
drawn each; ties of the score go to the smaller doc_id, then to fewer features; a null doc_id is drawn under the empty id and comes
first among ties; an empty target or an empty table works with counts of 0; columns with other names are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, lowered, ranked, slices, sums

#: Bytes of a word once A-Z are lowered: digits, small letters and all of other scripts.
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[97:123] = _LETTER[128:] = True

# Fixed values of the 64-bit xxHash.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


@dataclass(frozen=True)
class Plan:
    """n-grams of least to most words, their buckets, the seed of the draw, and the share of documents of min_words or more that it takes."""

    least: int = 1
    most: int = 1
    buckets: int = 10_000
    seed: int = 2024
    min_words: int = 20
    percent: int = 10


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """xxHash (64 bits, seed 0) of each [start, end) of a byte array; spans under 32 bytes advance together."""
    size = end - start
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    h = _P5 + size.astype(np.uint64)
    at = start.copy()
    for _ in range(3):
        live = np.flatnonzero((end - at >= 8) & (size < 32))
        if not len(live):
            break
        h[live] = _turned(h[live] ^ (_turned(eight[at[live]] * _P2, 31) * _P1), 27) * _P1 + _P4
        at[live] += 8
    live = np.flatnonzero((end - at >= 4) & (size < 32))
    h[live] = _turned(h[live] ^ ((eight[at[live]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    at[live] += 4
    for _ in range(3):
        live = np.flatnonzero((end > at) & (size < 32))
        if not len(live):
            break
        h[live] = _turned(h[live] ^ (padded[at[live]].astype(np.uint64) * _P5), 11) * _P1
        at[live] += 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(size >= 32):
        h[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes())
    return h


def _alike(data: np.ndarray, start: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether spans a[i] and b[i] hold the same bytes."""
    out = (end[a] - start[a]) == (end[b] - start[b])
    ask = np.flatnonzero(out & (a != b))
    size = (end - start)[a[ask]]
    first = np.cumsum(size) - size
    step = np.arange(int(size.sum())) - np.repeat(first, size)
    wrong = data[np.repeat(start[a[ask]], size) + step] != data[np.repeat(start[b[ask]], size) + step]
    out[ask] = sums(wrong, np.r_[first, len(step)]) == 0
    return out


class Table:
    """The distinct spans of a byte array in an open-addressed table: `slot` of each span, `bucket` and `count` of each slot in use."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int, keys: np.ndarray | None = None):
        keys = xxh64(data, start, end) if keys is None else keys
        mask = (1 << max(4, int(2 * len(start)).bit_length())) - 1
        owner = np.full(mask + 1, -1, np.int64)
        self.slot = np.full(len(start), -1, np.int64)
        left, probe = np.arange(len(start)), (keys & np.uint64(mask)).astype(np.int64)
        while len(left):
            free = owner[probe] < 0
            owner[probe[free]] = left[free]  # of several claims one stands
            held = owner[probe]
            same = keys[held] == keys[left]
            same[same] = _alike(data, start, end, left[same], held[same])
            self.slot[left[same]] = probe[same]
            left, probe = left[~same], (probe[~same] + 1) & mask
        used = np.flatnonzero(owner >= 0)
        self.bucket = np.zeros(mask + 1, np.int64)
        raw = data.tobytes()
        self.bucket[used] = [zlib.crc32(raw[start[i] : end[i]]) % buckets for i in owner[used].tolist()]
        self.count = np.bincount(self.slot, minlength=mask + 1)


def grams(data: np.ndarray, bounds: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, row) of every run of least to most words, in a buffer where one space joins the words, and words of each row."""
    data = lowered(data)
    letter = np.zeros(len(data) + 1, bool)
    letter[:-1] = _LETTER[data]
    fresh, stop = letter[:-1].copy(), letter[:-1].copy()
    fresh[1:] &= ~letter[:-2]
    stop &= ~letter[1:]
    full = bounds[:-1] < bounds[1:]
    fresh[bounds[:-1][full]] = letter[bounds[:-1][full]]
    stop[bounds[1:][full] - 1] = letter[bounds[1:][full] - 1]
    start, end = np.flatnonzero(fresh), np.flatnonzero(stop) + 1
    first = np.searchsorted(start, bounds)
    size = end - start + 1
    to = np.cumsum(size) - size
    joined = np.full(int(size.sum()), 32, np.uint8)
    step = np.arange(len(joined)) - np.repeat(to, size)
    word = step < np.repeat(size - 1, size)
    joined[word] = data[(np.repeat(start, size) + step)[word]]
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    starts, ends, of = [], [], []
    for n in range(least, most + 1):
        i = np.arange(max(0, len(start) - n + 1))
        i = i[rows[i] == rows[i + n - 1]] if len(i) else i
        starts.append(to[i])
        ends.append((to + size - 1)[i + n - 1] if len(i) else i)
        of.append(rows[i])
    return joined, np.concatenate(starts), np.concatenate(ends), np.concatenate(of), np.diff(first)


def bucket_counts(texts: DataFrame, plan: Plan) -> np.ndarray:
    """How many n-grams of all texts fall in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(plan.buckets, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                joined, start, end, _, _ = grams(*buffers(part.column(0)), plan.least, plan.most)
                table = Table(joined, start, end, plan.buckets)
                total += np.bincount(table.bucket, table.count, plan.buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": some, "n": total[some]})

    out = np.zeros(plan.buckets, np.int64)
    for bucket, n in texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # plan.buckets rows at most
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: thousandths of the log of how much likelier it is in the target, with one added to every count."""
    m = len(source)
    s, t = int(source.sum()) + m, int(target.sum()) + m
    return np.array([math.floor(1000 * math.log(float((b + 1) * s) / float((a + 1) * t))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def luck(seed: int, doc_id: int | None) -> int:
    """Gumbel noise in thousandths, from the id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: np.ndarray, plan: Plan) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                joined, start, end, row, n_words = grams(*buffers(part.column(1)), plan.least, plan.most)
                table = Table(joined, start, end, plan.buckets)
                order = np.argsort(row, kind="stable")
                of = np.searchsorted(row[order], np.arange(part.num_rows + 1))
                total, n = sums(gain[table.bucket][table.slot][order], of), np.diff(of)
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                score = weight + np.array([luck(plan.seed, x) for x in part.column(0).to_pylist()], np.int64)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "n_words": n_words.astype(np.int64), "n_features": n, "weight": weight, "score": score})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words) of every document; rank is its place in the draw, null for those not drawn."""
    gain = gains(bucket_counts(docs, plan), bucket_counts(target, plan))
    scored = weighed(docs, gain, plan).withColumn("_short", F.col("n_words") < plan.min_words).withColumn("_less", -F.col("score"))
    placed, _ = ranked(scored, ["_short", "_less", "doc_id", "n_features"], "_place")
    able = placed.where(~F.col("_short")).count()
    drawn = ~F.col("_short") & (F.col("_place") < able * plan.percent // 100)
    return placed.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("_place") + 1).alias("rank"), "n_words")
