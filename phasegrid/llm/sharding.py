"""Hilbert-curve sharding: quantise metadata, sort by curve index, cut the order into equal runs.

Equal texts stand side by side: all take the cells of the one with the least doc_id. Only DataFrame functions are used. Defined
cases: a null text has size 0 plus the overhead and counts as the empty one; nulls of a hashed dimension fall in cell 0; null doc_ids come
last among equal texts; repeated rows are rows of their own; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked, text_of, with_groups


def log_cell(x: Column, bits: int, steps: int = 3) -> Column:
    """Cell of a size: `steps` cells for each doubling."""
    return F.least(F.lit((1 << bits) - 1), F.floor(F.log2(F.greatest(x, F.lit(1)).cast("double")) * steps)).cast("int")


def hash_cell(x: Column, bits: int) -> Column:
    """Cell of a name: equal names share one, so a reader can work out where to look."""
    return F.coalesce(F.crc32(x.cast("string")) % (1 << bits), F.lit(0)).cast("int")


def _machine(n: int) -> tuple[list[int], list[int]]:
    """For state (entry corner, direction) and the next bit of each of n axes: the digit and the next state."""
    full = (1 << n) - 1
    turn = lambda x, k: ((x << (k % n)) | (x >> (n - k % n))) & full
    gray = [i ^ (i >> 1) for i in range(1 << n)]
    digit_of = {g: i for i, g in enumerate(gray)}
    ones = lambda x: (~x & (x + 1)).bit_length() - 1  # noqa: E731  trailing set bits
    digits, states = [], []
    for entry in range(1 << n):
        for axis in range(n):
            for corner in range(1 << n):
                w = digit_of[turn(corner ^ entry, n - (axis + 1) % n)]
                start = gray[2 * ((w - 1) // 2)] if w else 0
                step = 0 if not w else (ones(w) if w % 2 else ones(w - 1)) % n
                digits.append(w)
                states.append((entry ^ turn(start, axis + 1)) * n + (axis + step + 1) % n)
    return digits, states


def hilbert(cells: list[Column], bits: int) -> Column:
    """Index along the Hilbert curve of the cell whose coordinates, each below 2**bits, are given."""
    n = len(cells)
    if n < 2 or n > 4 or n * bits > 62:
        raise ValueError("2 to 4 dimensions of at most 62 bits together")
    digits, states = (F.lit(x) for x in _machine(n))

    def step(acc: Column, bit: Column) -> Column:
        corner = sum((F.call_function("shiftright", c, bit).bitwiseAND(1) * (1 << j) for j, c in enumerate(cells)), F.lit(0))
        at = (acc["state"] * (1 << n) + corner + 1).cast("int")
        return F.struct(F.element_at(states, at).cast("int").alias("state"), (acc["index"] * (1 << n) + F.element_at(digits, at)).cast("long").alias("index"))

    return F.aggregate(F.array(*(F.lit(b) for b in range(bits - 1, -1, -1))), F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index")), step)["index"]


def _placed(docs: DataFrame, n_shards: int, bits: int, doc_id: str, text: str, names: tuple[str, ...], overhead: int, whole: bool) -> DataFrame:
    body = text_of(text)
    size = F.octet_length(body).cast("long")
    cells = [hash_cell(F.col(c), bits).alias(f"c{i}") for i, c in enumerate(names)]
    rows = docs.select(F.col(doc_id).alias("doc_id"), (size + overhead).alias("size"), F.crc32(body).cast("long").alias("text_crc32"), F.xxhash64(body).alias("_same"), F.struct(*cells).alias("_cells"), *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")] if whole else []))
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_cells"))
    rows = with_groups(rows, ["_same", "text_crc32", "size"], F.xxhash64("doc_id"), {"_least": least}, {"_least": F.min("_least")})
    rows = rows.withColumn("_at", log_cell(F.col("size") - overhead, bits)).withColumn("curve", hilbert([F.col("_at"), *(F.col(f"_least._cells.c{i}") for i in range(len(names)))], bits))
    rows = rows.drop("_at", "_least", "_cells").withColumn("_tie", F.monotonically_increasing_id())
    order, total = ranked(rows, ["curve", "text_crc32", "size", "_same", "doc_id", "_tie"])
    shard = F.expr(f"_rank * {n_shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {max(total, 1)} + {n_shards - 1}) div {n_shards}")
    return order.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("_rank") - first).cast("long"))


def hilbert_shards(docs: DataFrame, n_shards: int = 24, bits: int = 6, doc_id: str = "doc_id", text: str = "text", names: tuple[str, ...] = ("source", "lang"), overhead: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, curve, shard, slot): runs of the curve whose row counts differ by one at most."""
    return _placed(docs, n_shards, bits, doc_id, text, names, overhead, False).select("doc_id", "size", "text_crc32", "curve", "shard", "slot")


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, bits: int = 6, doc_id: str = "doc_id", text: str = "text", names: tuple[str, ...] = ("source", "lang"), overhead: int = 8) -> DataFrame:
    """Write every row of docs under one folder for each shard, rows in slot order; returns the bounds of each shard for pruning.

    Ids may be null or repeat. The folder's partition column is `shard`, so docs must not have one.
    """
    if any(c.lower() == "shard" for c in docs.columns):
        raise ValueError("docs have a column named shard")
    places = _placed(docs, n_shards, bits, doc_id, text, names, overhead, True)
    placed = places.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").select("_row.*", "shard")
    placed.write.mode("overwrite").partitionBy("shard").parquet(path)
    return places.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("bytes"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.min("curve").alias("min_curve"), F.max("curve").alias("max_curve"))
