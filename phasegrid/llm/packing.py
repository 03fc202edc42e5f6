"""Length buckets: a dynamic programme over the global length histogram picks the bounds with least padding;
batches within a token budget form inside each bucket.

Texts longer than `max_len` tokens are cut into pieces of max_len, nothing is dropped, so the
histogram has at most max_len + 1 entries whatever the corpus. Defined cases: a null or empty text is one piece
of 0 tokens; repeated rows are packed each; an empty table gives no rows; columns with other names are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, ranked, text_of


def best_bounds(histogram: dict[int, int], n_buckets: int) -> tuple[list[int], int]:
    """Upper bounds (each a length that occurs) with the least total padding, and that padding."""
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return [], 0
    counts = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    rows, tokens = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * lengths)]
    d, k = len(lengths), min(n_buckets, len(lengths))
    best = np.r_[0, np.full(d, np.iinfo(np.int64).max // 2)]
    came = np.zeros((k, d + 1), np.int64)
    for j in range(k):
        now = np.full(d + 1, np.iinfo(np.int64).max // 2)
        for end in range(1, d + 1):
            cost = best[:end] + lengths[end - 1] * (rows[end] - rows[:end]) - (tokens[end] - tokens[:end])
            came[j, end] = at = int(np.argmin(cost))
            now[end] = cost[at]
        best = now
    bounds, end = [], d
    for j in range(k - 1, -1, -1):
        bounds.append(int(lengths[end - 1]))
        end = came[j, end]
    return bounds[::-1], int(best[d])


def pieces(docs: DataFrame, max_len: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, n_tokens): consecutive runs of at most max_len words of each text."""
    n = F.regexp_count(text_of(text), F.lit(WORD)).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), n.alias("_n"))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("_n") - 1, F.lit(0)) / max_len))))
    start = F.col("piece") * max_len
    return rows.select("doc_id", "piece", start.alias("start"), F.least(F.col("_n") - start, F.lit(max_len)).cast("long").alias("n_tokens"))


def pack(docs: DataFrame, n_buckets: int = 12, budget: int = 32768, max_len: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, n_tokens, bucket, bucket_len, batch, slot).

    A batch holds rows of one bucket, and its rows times bucket_len stay within the budget (one row, if a
    single row exceeds it). Batches are full but for the last of each bucket. The order in a
    bucket is by a hash of doc_id, so that sources mix.
    """
    rows = cut(pieces(docs, max_len, doc_id, text).withColumn("_mix", F.xxhash64("doc_id", "piece")).withColumn("_tie", F.monotonically_increasing_id()))
    histogram = {r[0]: r[1] for r in rows.groupBy("n_tokens").agg(F.count("*")).collect()}  # at most max_len + 1 rows
    bounds, _ = best_bounds(histogram, n_buckets)
    buckets, batch, first = [], 0, 0
    for i, bound in enumerate(bounds):
        size = sum(n for x, n in histogram.items() if (not i or x > bounds[i - 1]) and x <= bound)
        per = max(1, budget // max(bound, 1))
        buckets.append((bound, per, batch, first, size))
        batch, first = batch + -(-size // per), first + size
    if not buckets:
        buckets = [(0, 1, 0, 0, 0)]
    at = F.size(F.filter(F.lit([b[0] for b in buckets]), lambda b: b < F.col("n_tokens")))
    of = lambda k: F.element_at(F.array(*(F.lit(b[k]).cast("long") for b in buckets)), F.col("bucket") + 1)
    mixed, _ = ranked(rows.withColumn("bucket", at), ["bucket", "_mix", "doc_id", "piece", "_tie"], "_place")
    inside = F.col("_place") - of(3)
    return mixed.select("doc_id", "piece", "start", "n_tokens", "bucket", of(0).alias("bucket_len"), (of(2) + F.floor(inside / of(1))).cast("long").alias("batch"), (inside % of(1)).cast("long").alias("slot"))


def batches(packed: DataFrame) -> DataFrame:
    """(batch, bucket, bucket_len, n_rows, n_tokens, n_padding) of pack()'s rows."""
    return packed.groupBy("batch", "bucket", "bucket_len").agg(F.count("*").alias("n_rows"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("bucket_len") - F.col("n_tokens")).alias("n_padding"))
