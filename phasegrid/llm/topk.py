"""Exact top-k inner products by the threshold algorithm over lists sorted by dimension.

Candidates are dealt into blocks. In a block every dimension has its list, and each query walks all lists in step, from the end
where its own component wants large products: rows met for the first time are scored in full, and the walk stops once
the kth score exceeds the bound on what is still unseen. Blocks come in rounds, each of four times as many as all before: a round starts from
the kth score of the rounds before, so a walk stops as soon as the bound falls below it, and gives only rows that reach it.

Defined cases: rows without id, with a null vector, or with null or non-finite components take no part; vectors
of other lengths count as padded by zeros; a query skips all rows with its own id; rows that repeat an id are candidates each, and queries of their own, with k rows each; ties go to
the smaller id; an empty table gives no rows; columns with other names are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Candidates of a block, and queries that one task walks over it.
BLOCK, QUERIES = 8192, 2048


def threshold_walk(rows: np.ndarray, ids: np.ndarray, down: np.ndarray, query: np.ndarray, own: int, k: int, first: int = 24, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores, rows read) of the k best rows among those that score `floor` at least. down[d]: rows in falling order of dimension d."""
    dims = np.flatnonzero(query)
    n = len(rows)
    other = ids != own
    if not len(dims):
        at = np.flatnonzero(other)
        at = at[np.argsort(ids[at], kind="stable")[:k]] if floor <= 0 else at[:0]
        return ids[at], np.zeros(len(at), rows.dtype), n
    weight, rising = query[dims], (query[dims] < 0)[:, None]
    lists = down[dims]
    seen = np.zeros(n, bool)
    best, scores = np.zeros(0, np.int64), np.zeros(0, rows.dtype)
    lo, hi = 0, min(first, n)
    while True:
        met = np.where(rising, lists[:, n - hi : n - lo], lists[:, lo:hi])
        fresh = np.zeros(n, bool)
        fresh[met.ravel()] = True
        fresh &= ~seen
        seen |= fresh
        fresh &= other
        at = np.flatnonzero(fresh)
        found = rows[at] @ query
        best, scores = np.r_[best, at[found >= floor]], np.r_[scores, found[found >= floor]]
        keep = np.lexsort((ids[best], -scores))[:k]
        best, scores = best[keep], scores[keep]
        if hi == n:
            break
        edge = np.where(rising[:, 0], lists[:, n - hi], lists[:, hi - 1])
        bound = (weight * rows[edge, dims]).sum()
        if bound < floor or len(best) == k and scores[-1] > bound:
            break
        lo, hi = hi, min(2 * hi, n)
    return ids[best], scores, int(seen.sum())


def _walk(k: int):
    def matrix(t: pa.Table, width: int) -> np.ndarray:
        lists = t["items"].combine_chunks() if isinstance(t["items"], pa.ChunkedArray) else t["items"]
        n = lists.value_lengths().to_numpy(zero_copy_only=False)
        out = np.zeros((len(lists), width), np.int64)
        row = np.repeat(np.arange(len(lists)), n)
        out[row, np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)] = lists.flatten().to_numpy()
        return out

    def run(cands: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if cands.num_rows and queries.num_rows:
            width = max(max(x["items"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max() for x in (cands, queries)), 1)
            rows, asked = matrix(cands, width), matrix(queries, width)
            # float64 holds these products exactly below 2**53, and is quicker.
            if float(np.abs(rows).max()) * float(np.abs(asked).max()) * width < 2**52:
                rows, asked = rows.astype(np.float64), asked.astype(np.float64)
            ids = cands["vec_id"].to_numpy()
            down = np.ascontiguousarray(np.argsort(-rows, axis=0, kind="stable").T)
            for q, own, ask, floor in zip(asked, queries["vec_id"].to_numpy(), queries["ask"].to_numpy(), queries["floor"].to_pylist()):
                best, scores, _ = threshold_walk(rows, ids, down, q, own, k, floor=-np.inf if floor is None else floor)
                found.append((np.full(len(best), own), np.full(len(best), ask), best, scores.astype(np.int64)))
        cols = [np.concatenate([f[j] for f in found]) if found else np.zeros(0, np.int64) for j in range(4)]
        return pa.table(dict(zip(("query_id", "ask", "vec_id", "score"), (pa.array(c, pa.int64()) for c in cols))))

    return run


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer products of floor(scale * x) for each row where is_query (over vec_id)."""
    x = F.col(vector)
    sound = F.col(vec_id).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = vectors.where(sound).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("items"))
    rows = cut(whole.withColumns({"asks": is_query, "ask": F.monotonically_increasing_id()}))
    n, m = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("asks").cast("int")), F.lit(0))).first()
    blocks, parts = max(1, -(-n // BLOCK)), max(1, -(-m // QUERIES))
    # By position too, so that a repeated id is spread.
    place = F.pmod(F.xxhash64("vec_id", "ask"), F.lit(1 << 40))
    cands = rows.select("vec_id", "items", (place % blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    asks = rows.where("asks").select("vec_id", "ask", "items", (place % parts).cast("int").alias("part"))
    best, lo = None, 0
    while lo < blocks:
        hi = min(blocks, 4 * lo + 1)
        known = asks.withColumn("floor", F.lit(None).cast("long")) if best is None else asks.join(best.where(F.col("rank") == k).select("ask", F.col("score").alias("floor")), "ask", "left")
        known = known.withColumn("block", F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi - 1).cast("long"))))
        known = known.select(*(F.col(c).alias(c) for c in known.columns))  # columns of its own, as both sides come from one table
        here = cands.where((F.col("block") >= lo) & (F.col("block") < hi))
        found = here.groupBy("block", "part").cogroup(known.groupBy("block", "part")).applyInArrow(_walk(k), "query_id long, ask long, vec_id long, score long")
        found = found if best is None else found.unionByName(best.drop("rank"))
        rank = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id"))
        best, lo = cut(found.withColumn("rank", rank).where(F.col("rank") <= k)), hi
    return best.select("query_id", "rank", "vec_id", "score")
