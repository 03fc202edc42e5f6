"""What the operators share: cut lineage, a global rank without one big task, text as numpy."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What Python sees as a word everywhere here: runs of bytes other than blank and tab..carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, kept in the cluster's shared checkpoint folder (a temporary one only where none is set, as in tests)."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def with_groups(df: DataFrame, keys: list[str], salt: Column, each: dict[str, Column], joint: dict[str, Column], where: str = "true", n: int = 32) -> DataFrame:
    """df beside what its groups hold: `each` aggregates rows of a group, `joint` the results of these.

    Groups are dealt over n salts, before the aggregate and for the join, so a group of a third of all rows is no single task's work.
    """
    salted = df.withColumn("_salt", F.pmod(salt, F.lit(n)).cast("int"))
    parts = salted.groupBy(*keys, "_salt").agg(*(c.alias(x) for x, c in each.items()))
    whole = parts.groupBy(*keys).agg(*(c.alias(x) for x, c in joint.items()), F.collect_set("_salt").alias("_salts")).where(where)  # n salts at most
    return salted.join(whole.withColumn("_salt", F.explode("_salts")).drop("_salts"), [*keys, "_salt"]).drop("_salt")


def beside(df: DataFrame, other: DataFrame, key: str, salt: Column, n: int = 32) -> DataFrame:
    """Inner join of df with other, whose keys are unique; rows of one key are dealt over n salts."""
    salted = df.withColumn("_salt", F.pmod(salt, F.lit(n)).cast("int"))
    used = salted.select(key, "_salt").distinct()
    return salted.join(other.join(used, key), [key, "_salt"]).drop("_salt")


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with lines below put before it until no column of df has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def compact(df: DataFrame, rows: int, per: int = 50_000) -> DataFrame:
    """df in fewer partitions where it has few rows, so that the next exchange leaves fewer files."""
    return df.coalesce(max(8, rows // per))


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def ranked(df: DataFrame, by: list[str], rank: str = "_rank") -> tuple[DataFrame, int]:
    """df with its 0-based position in the order of `by`, and the number of rows.

    Rows are dealt out by range and sorted in place; only one count for each partition reaches the
    driver. Put a unique column last in `by`, so that ranges can divide rows that are alike otherwise.
    """
    spark = df.sparkSession
    kept = cut(df.repartitionByRange(parallelism(spark), *by).sortWithinPartitions(*by).withColumn(rank, F.monotonically_increasing_id()))
    place = F.shiftrightunsigned(F.col(rank), 33)
    counts = dict(kept.groupBy(place.alias("_p")).agg(F.count("*").alias("_n")).collect())
    before, total = [], 0
    for p in range(max(counts, default=0) + 1):
        before.append(total)
        total += counts.get(p, 0)
    starts = F.array(*(F.lit(x).cast("long") for x in before))
    return kept.withColumn(rank, F.element_at(starts, (place + 1).cast("int")) + F.col(rank).bitwiseAND((1 << 33) - 1)), total


def text_of(col: str | Column) -> Column:
    """The text, null as the empty one."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


# ---- text as numpy, inside tasks ----

_ODD = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_INV = pow(_ODD, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
#: Chunks of eight bytes that one step of the hash joins.
_FAN = 8
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each [start, end) of a byte array, in time proportional to their length.

    Eight bytes at a time are mixed, then eight of these at a time, and so on. Nothing is summed or multiplied through by powers, so
    texts of regular structure do not collide as they do under a polynomial modulo 2**64.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    at_byte = np.ndarray((len(data) + 1,), np.uint64, padded, strides=(1,))
    size = end - start
    count = np.maximum(1, -(-size // 8))
    first = np.cumsum(count) - count
    k = np.arange(int(count.sum())) - np.repeat(first, count)
    left = np.repeat(size, count) - 8 * k
    values = mix((at_byte[np.repeat(start, count) + 8 * k] & _TAIL[np.clip(left, 0, 8)]) + np.uint64(_ODD))
    while len(values) > len(count):
        groups = -(-count // _FAN)
        begin = np.cumsum(groups) - groups
        place = np.arange(int(groups.sum())) - np.repeat(begin, groups)
        lead = np.repeat(first, groups) + _FAN * place
        held = np.minimum(np.repeat(count, groups) - _FAN * place, _FAN)
        out = values[lead]
        for j in range(1, _FAN):
            more = np.flatnonzero(held > j)
            if not len(more):
                break
            out[more] = mix(out[more] * np.uint64(_ODD) + values[lead[more] + j] + np.uint64(j))
        values, first, count = out, begin, groups
    return mix(values + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        x = np.full(1 << max(16, int(n - 1).bit_length()), base, np.uint64)
        x[0] = 1
        _POWERS[base] = np.multiply.accumulate(x)
    return _POWERS[base][:n]


class Rolling:
    """Keys of any [start, end) of a sequence in constant time each. Equal spans have equal keys, but unequal ones may too: keys only
    bring together what is then compared symbol by symbol (or by `hashed`, or a digest)."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(symbols.astype(np.uint64) + np.uint64(0x1234567)) * _powers(_ODD, n), out=self.sums[1:])
        self.back = _powers(_INV, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the row bounds in them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary())
    if column.null_count:
        column = column.fill_null(b"")
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    n, at = len(column), column.offset
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], wide, count=at + n + 1)[at:].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def slices(batch: pa.RecordBatch, text: str | int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of whole rows with about `most` bytes of text, so that memory stays small."""
    for at in portions(np.diff(buffers(batch.column(text))[1]).tolist(), most):
        yield batch.slice(at.start, at.stop - at.start)


def portions(sizes: list[int], most: int = 1 << 20) -> Iterator[slice]:
    """Slices of consecutive items with about `most` bytes each."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield slice(start, i)
            start, held = i, 0
        held += size + 64
    if start < len(sizes):
        yield slice(start, len(sizes))


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of the first word of each row (with the total last)."""
    space = _SPACE[data]
    first, last = np.ones(len(data), bool), np.ones(len(data), bool)
    first[1:], last[:-1] = space[:-1], space[1:]
    full = bounds[:-1] < bounds[1:]
    first[bounds[:-1][full]] = True
    last[bounds[1:][full] - 1] = True
    starts = np.flatnonzero(first & ~space)
    return starts, np.flatnonzero(last & ~space) + 1, np.searchsorted(starts, bounds)


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values over each [bounds[i], bounds[i+1])."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the cluster's shared checkpoint folder."""
    import uuid

    cut(spark.range(0)) if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty() else None
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
