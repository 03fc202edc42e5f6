"""Suffix-array dedup: cover every byte of a string of `length` bytes that starts at another place too.

Each window of `length` bytes is filed under its least gram (a minimiser), so equal windows meet under one key and
at one offset from it. Runs of windows with one key form a block. Keys that occur once are dropped; blocks of equal bytes (by a
digest of them) count once, with their number. What is left is decided by a column-wise construction over collections of
blocks: the blocks of whole keys, lined up at their gram. Every round inserts one symbol of each block, from the right. It extends the
collection's Burrows-Wheeler transform by the symbols before the suffixes of the last round, in their order, finds the place of each
new suffix from these symbols alone, and extends the common prefixes likewise. Symbols count as tagged with their column, so the
suffixes of a column stand together in the transform: a round adds its segment at the end and leaves earlier ones as they are.
Transform and prefixes are sequential files in the shared folder; memory holds a few numbers for each block. Reading both files from front to
back then gives the windows: one is repeated if a neighbour in its column shares `length` symbols.

A key with more than MOST_BLOCKS different blocks is divided before that, so that a collection fits a task: each block in two, filed under the
bytes that all windows of a half share, again where needed. The construction decides each part as it does whole keys.

Defined cases: null and empty texts have no bytes; texts below `length` bytes lose none; repeated rows, with equal doc_id or a
null one, count as copies of each other; an empty table gives no rows; columns with other names are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, beside, buffers, compact, cut, free_name, mix, scratch, text_of, with_groups

#: Bytes of the grams that windows are filed under.
GRAM = 80
#: Different blocks of a key that one collection takes (about 2.5 MB of text).
MOST_BLOCKS = 4096
#: No UTF-8 text holds this byte.
PAD = 0xFF
_PIECE = 1 << 21


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A digest of the bytes of each [start, end) and of where its gram is."""
    raw = memoryview(np.ascontiguousarray(data))
    each = (hashlib.blake2b(raw[a:b], digest_size=8, salt=o.to_bytes(4, "little")).digest() for a, b, o in zip(start.tolist(), end.tolist(), off.tolist()))
    return np.frombuffer(b"".join(each), np.uint64)


def blocks_of(data: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(key, hash, lo, off, n): runs of n windows from lo on whose least gram is the one at lo + off."""
    parts = []
    for at in range(0, max(0, len(data) - length + 1), _PIECE):
        piece = data[at : at + _PIECE + length - 1]
        spans = Rolling(piece)
        i = np.arange(len(piece) - gram + 1)
        grams = spans.of(i, i + gram)
        packed = (grams & np.uint64(0xFFFFFFFFFF000000)) | i.astype(np.uint64)
        w, m = length - gram + 1, len(packed)
        square = np.full(-(-m // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
        square[:m] = packed
        square = square.reshape(-1, w)
        ahead = np.minimum.accumulate(square, 1).ravel()
        behind = np.minimum.accumulate(square[:, ::-1], 1)[:, ::-1].ravel()
        place = (np.minimum(behind[: m - w + 1], ahead[w - 1 : m]) & np.uint64(0xFFFFFF)).astype(np.int64)
        lo = np.r_[0, np.flatnonzero(place[1:] != place[:-1]) + 1]
        n = np.diff(np.r_[lo, len(place)])
        off = place[lo] - lo
        parts.append((grams[place[lo]], digests(piece, lo, lo + n - 1 + length, off), lo + at, off, n))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*parts))


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of [start, end) as maximal runs in order."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    fresh = np.r_[True, start[1:] > end[:-1]]
    return start[fresh], np.r_[end[:-1][fresh[1:]], end[-1]]


def least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo+1 .. hi]) for each lo < hi."""
    out = values[hi].copy()
    far = np.flatnonzero(hi - lo > 1)
    if len(far):
        lo, hi = lo[far] + 1, hi[far] + 1
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        row, width = values, 1
        for k in range(int(level.max()) + 1):
            if k:
                row = np.minimum(row[:-width], row[width:])
                width *= 2
            at = np.flatnonzero(level == k)
            out[far[at]] = np.minimum(row[lo[at]], row[hi[at] - width])
    return out


class Collection:
    """The transform of blocks of whole keys, lined up at their grams, in sequential files of a folder of its own."""

    def __init__(self, blocks: list[bytes], offs: np.ndarray, length: int, folder: str):
        """offs: where in a block its gram is; the folder is a path or URI."""
        self.length, self.count, self.left = length, len(blocks), int(offs.max(initial=0))
        self.width = max((self.left - int(o) + len(b) for o, b in zip(offs, blocks)), default=0)
        self.first = self.left - offs
        uri = folder.replace("file:", "file://", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
        self.files, path = fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)
        self.path = f"{path}/{uuid.uuid4().hex}"
        self.files.create_dir(self.path)
        symbols = np.full((self.count, self.width), PAD, np.uint8)
        for i, (b, o) in enumerate(zip(blocks, self.first.tolist())):
            symbols[i, o : o + len(b)] = np.frombuffer(b, np.uint8)
        with self._write("columns") as out:
            for c in range(self.width - 1, -1, -1):  # in the order of the rounds
                out.write(np.ascontiguousarray(symbols[:, c]).data)

    def _write(self, name: str):
        return self.files.open_output_stream(f"{self.path}/{name}", buffer_size=1 << 20)

    def _read(self, name: str):
        return self.files.open_input_stream(f"{self.path}/{name}", buffer_size=1 << 20)

    def _take(self, stream, kind: type) -> np.ndarray:
        return np.frombuffer(stream.read(self.count * np.dtype(kind).itemsize), kind)

    def insert_columns(self) -> "Collection":
        """Round by round, one symbol of each block."""
        m = self.count
        order, common = np.arange(m), np.zeros(m, np.int32)  # of the empty suffixes
        with self._read("columns") as columns, self._write("transform") as transform, self._write("prefixes") as prefixes:
            for _ in range(self.width):
                segment = self._take(columns, np.uint8)[order]
                transform.write(segment.data)
                # A suffix goes after those with smaller first symbols and, among those with its own, as the suffixes behind them stand.
                moved = np.argsort(segment, kind="stable")
                symbol = segment[moved]
                prefix = np.zeros(m, np.int32)
                same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] != PAD)) + 1
                prefix[same] = np.minimum(least_between(common, moved[same - 1], moved[same]) + 1, self.length)
                order, common = order[moved], prefix
                prefixes.write(prefix.data)
        return self

    def rows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(column, blocks in the order of their suffixes from there, common prefix of each suffix with the one before it), read back from the files."""
        order = np.arange(self.count)
        with self._read("transform") as transform, self._read("prefixes") as prefixes:
            for c in range(self.width - 1, -1, -1):
                order = order[np.argsort(self._take(transform, np.uint8), kind="stable")]
                yield c, order, self._take(prefixes, np.int32)

    def remove(self) -> None:
        self.files.delete_dir(self.path)


def repeated_starts(blocks: list[bytes], offs: np.ndarray, counts: np.ndarray, length: int, folder: str) -> np.ndarray:
    """For different blocks of whole keys: matrix[window, block], true where that window occurs in another of the blocks. counts: windows of each."""
    held = Collection(blocks, offs, length, folder)
    out = np.zeros((int(counts.max(initial=0)), len(blocks)), bool)
    try:
        for c, order, prefix in held.insert_columns().rows():
            full = prefix >= length
            if full.any():
                full[:-1] |= full[1:]  # both sides of a pair
                hit = order[full]
                at = c - held.first[hit]
                ok = (at >= 0) & (at < counts[hit])
                out[at[ok], hit[ok]] = True
    finally:
        held.remove()
    return out


def _runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False]))
    return edge[::2].tolist(), edge[1::2].tolist()


ANCHORS = "_id long, _th long, key long, hash long, lo int, off int, n int, copies long"
PARTS = "key long, hash long, block long, mark long, base int, off int, n int, different long, body binary"
FOUND = "block long, mark long, start int, stop int"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def find_anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = buffers(batch.column("_text"))
            ids, ths = (batch.column(c).to_numpy() for c in ("_id", "_th"))
            held: list[tuple] = []
            size = 0
            for i in np.flatnonzero(np.diff(bounds) >= length).tolist():
                key, hash_, lo, off, n = blocks_of(data[bounds[i] : bounds[i + 1]], length)
                _, at, of, copies = np.unique(hash_, return_index=True, return_inverse=True, return_counts=True)
                rows = len(at)
                held.append((np.full(rows, ids[i]), np.full(rows, ths[i]), _signed(key[at]), _signed(hash_[at]), lo[at], off[at], n[at], copies, np.ones(rows, bool)))
                again = copies[of] > 1
                if again.any():
                    s, e = merged(lo[again], lo[again] + n[again])
                    zero = np.zeros(len(s), np.int64)
                    held.append((np.full(len(s), ids[i]), np.full(len(s), ths[i]), zero, zero, s, zero, e - s, zero, zero.astype(bool)))
                    rows += len(s)
                size += rows
                if size > 50_000:
                    yield _rows(held)
                    held, size = [], 0
            if held:
                yield _rows(held)

    def _rows(held: list[tuple]) -> pa.RecordBatch:
        *cols, keyed = (np.concatenate(x) for x in zip(*held))
        kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k, mask=~keyed if j in (2, 3) else None) for j, (c, k) in enumerate(zip(cols, kinds))], names=_names(ANCHORS))

    return run


def cut_out(length: int):
    """The bytes of wanted blocks, from texts joined with lists of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = buffers(batch.column("_text"))
            wants = batch.column("wants")
            flat = wants.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(wants.offsets.to_numpy()))
            f = {c: flat.field(j).to_numpy() for j, c in enumerate(("key", "hash", "lo", "off", "n", "different"))}
            start = bounds[row] + f["lo"]
            view = memoryview(np.ascontiguousarray(data))
            for s in range(0, len(row), 8192):
                e = slice(s, s + 8192)
                bodies = [bytes(view[a : a + n - 1 + length]) for a, n in zip(start[e].tolist(), f["n"][e].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(f["key"][e]), pa.array(f["hash"][e]), pa.array(f["key"][e]), pa.array(f["hash"][e]), pa.array(np.zeros(len(bodies), np.int32)), pa.array(f["off"][e].astype(np.int32)), pa.array(f["n"][e].astype(np.int32)), pa.array(f["different"][e]), pa.array(bodies, pa.binary())], names=_names(PARTS))

    return run


def halve(length: int, width: int):
    """Each block as two, filed under the hash of the bytes that all its windows share.

    d is how far before its gram a window starts. Cuts are where d is a multiple of width for every block, so that equal
    windows stay together; before, no block crosses a multiple of 2 * width.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                rows = batch.slice(s, 2048)
                key, block, mark, base, off, n = (rows.column(c).to_numpy() for c in ("key", "block", "mark", "base", "off", "n"))
                data, bounds = buffers(rows.column("body"))
                spans = Rolling(data)
                out = []
                split = off // (2 * width) * (2 * width) + width
                first = np.clip(off - split + 1, 0, n)  # windows with d >= split
                for lo, hi, least in ((np.zeros_like(n), first, split), (first, n, split - width)):
                    at = np.flatnonzero(hi > lo)
                    lo, hi, d0 = lo[at], hi[at], least[at]
                    d1 = d0 + width - 1
                    gram = bounds[at] + off[at]
                    core = spans.of(gram - d0, gram - d1 + length)
                    new = mix(core ^ mix(key[at].view(np.uint64) + d1.astype(np.uint64)))
                    own = digests(data, bounds[at] + lo, bounds[at] + hi - 1 + length, off[at] - lo)
                    raw = memoryview(np.ascontiguousarray(data))
                    out.append((_signed(new), _signed(own), block[at], mark[at], base[at] + lo, off[at] - lo, hi - lo, [bytes(raw[a:b]) for a, b in zip((bounds[at] + lo).tolist(), (bounds[at] + hi - 1 + length).tolist())]))
                cols = [np.concatenate([o[j] for o in out]) for j in range(7)]
                kinds = [pa.int64()] * 4 + [pa.int32()] * 3
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds)), pa.nulls(len(cols[0]), pa.int64()), pa.array(out[0][7] + out[1][7], pa.binary())], names=_names(PARTS))

    return run


def construct(length: int, folder: str, most: int = 4096):
    """Column-wise construction over whole keys, which come one after another, equal blocks side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> pa.RecordBatch:
            key, own = rows["key"].to_numpy(), rows["hash"].to_numpy()
            rows = rows.filter(pa.array(np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])]))
            offs, n = rows["off"].to_numpy(), rows["n"].to_numpy()
            flags = repeated_starts(rows["body"].to_pylist(), offs, n, length, folder)
            which, starts, stops = [], [], []
            for i in np.flatnonzero(flags.any(0)).tolist():
                s, e = _runs(flags[: n[i], i])
                which += [i] * len(s)
                starts += s
                stops += e
            base = rows["base"].to_numpy()[which].astype(np.int32) if which else np.zeros(0, np.int32)
            return pa.RecordBatch.from_arrays([rows["block"].combine_chunks().take(pa.array(which, pa.int64())), rows["mark"].combine_chunks().take(pa.array(which, pa.int64())), pa.array(base + np.array(starts, np.int32)), pa.array(base + np.array(stops, np.int32))], names=_names(FOUND))

        def whole() -> pa.Table:
            return pa.Table.from_batches(held)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= most:
                rows = whole()
                keys = rows["key"].to_numpy()
                last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
                if last:
                    yield flush(rows.slice(0, last))
                held = rows.slice(last).to_batches()
        if held and sum(b.num_rows for b in held):
            yield flush(whole())

    return run


def _base(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = text_of(text)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("_id"), F.xxhash64(body).alias("_th"), body.cast("binary").alias("_text"))


def repeated_spans(base: DataFrame, length: int, most_blocks: int | None = None) -> DataFrame:
    """(_id, _th, spans): the covered [s, e) of each text that has any, not merged."""
    most_blocks = most_blocks or MOST_BLOCKS
    folder = scratch(base.sparkSession, "collections")
    anchors = cut(base.select("_id", "_th", "_text").mapInArrow(find_anchors(length), ANCHORS))
    known = cut(with_groups(anchors.where("key is not null"), ["key"], F.xxhash64("_id", "_th", "lo"), {"m": F.sum("copies")}, {"m": F.sum("m")}, "m > 1").drop("m"))
    blocks = known.groupBy("key", "hash").agg(F.sum("copies").alias("copies"), F.min(F.struct("_id", "_th", "lo", "off", "n")).alias("at"))
    blocks = cut(with_groups(blocks, ["key"], F.col("hash"), {"different": F.count("*")}, {"different": F.sum("different")}))
    found = blocks.where("copies > 1").select(F.col("key").alias("block"), F.col("hash").alias("mark"), F.lit(0).alias("start"), F.col("at.n").alias("stop"))
    # Text of one row for each of the different blocks of keys that have several.
    several = blocks.where("different > 1")
    n_parts, widest = several.agg(F.count("*"), F.max("different")).first()
    wanted = several.groupBy("at._id", "at._th").agg(F.collect_list(F.struct("key", "hash", "at.lo", "at.off", "at.n", "different")).alias("wants"))
    parts = base.select("_id", "_th", "_text").join(wanted, ["_id", "_th"]).mapInArrow(cut_out(length), PARTS)
    divided = (widest or 0) > most_blocks
    if divided:
        parts = compact(cut(parts), n_parts, 2000)
    found = found.unionByName(_constructed(parts.where(F.col("different") <= most_blocks), length, folder, n_parts))
    large = parts.where(F.col("different") > most_blocks).dropDuplicates(["key", "hash"])
    width = 1 << (length - GRAM).bit_length()
    while divided and width > 1 and (n_large := large.count()):
        width //= 2
        split = compact(cut(compact(large, n_large, 2000).mapInArrow(halve(length, width), PARTS)), 2 * n_large, 2000).drop("different")
        kinds = split.groupBy("key", "hash").agg(F.count("*").alias("copies"), F.min(F.struct("block", "mark")).alias("one"))
        kinds = compact(cut(with_groups(kinds, ["key"], F.col("hash"), {"different": F.count("*")}, {"different": F.sum("different")})), 2 * n_large, 20_000)
        # Copies of one part: all its windows are repeated.
        twice = kinds.where("copies > 1").select("key", "hash")
        found = found.unionByName(split.join(twice, ["key", "hash"]).select("block", "mark", F.col("base").alias("start"), (F.col("base") + F.col("n")).alias("stop")))
        left = split.join(kinds.where("different > 1").select("key", "hash", "one", "different"), ["key", "hash"]).where("one.block = block and one.mark = mark").drop("one")
        left = compact(cut(left), 2 * n_large, 2000)
        found = found.unionByName(_constructed(left.where(F.col("different") <= most_blocks), length, folder, 2 * n_large))
        large = left.where(F.col("different") > most_blocks)
    runs = found.groupBy(F.struct(F.col("block").alias("key"), F.col("mark").alias("hash")).alias("of")).agg(F.collect_set(F.struct("start", "stop")).alias("runs"))
    hit = beside(known.select(F.struct("key", "hash").alias("of"), "_id", "_th", "lo"), runs, "of", F.xxhash64("_id", "_th", "lo"))
    marks = hit.select("_id", "_th", "lo", F.explode("runs").alias("r")).select("_id", "_th", (F.col("lo") + F.col("r.start")).alias("s"), (F.col("lo") + F.col("r.stop") - 1 + length).alias("e"))
    inside = anchors.where("key is null").select("_id", "_th", F.col("lo").alias("s"), (F.col("lo") + F.col("n") - 1 + length).alias("e"))
    return marks.unionByName(inside).groupBy("_id", "_th").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def _constructed(parts: DataFrame, length: int, folder: str, n_parts: int) -> DataFrame:
    filed = parts.select(*_names(PARTS)).repartition("key") if n_parts > 50_000 else parts.select(*_names(PARTS)).repartition(max(8, n_parts // 500), "key")
    return filed.sortWithinPartitions("key", "hash").mapInArrow(construct(length, folder), FOUND)


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _trimmed(batch: pa.RecordBatch, text: int, spans: int, whole_characters: bool) -> Iterator[tuple[memoryview, np.ndarray, np.ndarray]]:
    """(bytes, starts, ends of removed runs) of every row."""
    data, bounds = buffers(batch.column(text))
    lists = batch.column(spans)
    flat = lists.flatten()
    each = [flat.field(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in (0, 1)]
    ends = np.r_[0, np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]
    raw = memoryview(np.ascontiguousarray(data))
    for i in range(batch.num_rows):
        s, e = merged(*(x[ends[i] : ends[i + 1]] for x in each))
        own = raw[bounds[i] : bounds[i + 1]]
        if whole_characters and len(s):
            inner = lambda at: at < len(own) and own[at] & 0xC0 == 0x80
            for k in range(len(s)):
                while s[k] < e[k] and inner(s[k]):
                    s[k] += 1
                while e[k] > s[k] and inner(e[k]):
                    e[k] -= 1
            s, e = s[e > s], e[e > s]
        yield own, s, e


def _left(own: memoryview, s: np.ndarray, e: np.ndarray) -> bytes:
    return b"".join(own[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(own)]))


def remove_repeats(docs: DataFrame, length: int = 400, doc_id: str = "doc_id", text: str = "text", with_text: bool = False, whole_characters: bool = False, most_blocks: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): and, with_text, kept (binary) and spans.

    whole_characters: spans shrink to full UTF-8 characters, so that what is kept is valid text.
    """
    base = _base(docs, doc_id, text)
    spans = repeated_spans(base.select("_id", "_th", "_text"), length, most_blocks)
    schema = KEPT + (", kept binary, spans array<struct<s:int,e:int>>" if with_text else "")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs, shas, kept, gone = [], [], [], [], [], []
            for own, s, e in _trimmed(batch, 1, 2, whole_characters):
                rest = _left(own, s, e)
                sizes.append(len(own))
                removed.append(int((e - s).sum()))
                runs.append(len(s))
                shas.append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    kept.append(rest)
                    gone.append([{"s": a, "e": b} for a, b in zip(s.tolist(), e.tolist())])
            cols = [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs)), pa.array(shas, pa.string())]
            if with_text:
                cols += [pa.array(kept, pa.binary()), pa.array(gone, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))]
            yield pa.RecordBatch.from_arrays(cols, names=[*_names(KEPT), *(["kept", "spans"] if with_text else [])])

    return base.join(spans, ["_id", "_th"], "left").select("doc_id", "_text", "spans").mapInArrow(apply, schema)


def without_repeats(docs: DataFrame, length: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, their text without repeated passages (cut at whole characters). A null text stays null; columns may have any names."""
    spans = repeated_spans(_base(docs, doc_id, text).select("_id", "_th", "_text"), length)
    keys = [free_name(docs, "_id"), free_name(docs, "_th")]
    own, names = free_name(docs, "_spans"), tuple(docs.columns)
    keyed = docs.withColumns({keys[0]: F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))), keys[1]: F.xxhash64(text_of(text))})
    joined = keyed.join(spans.select(F.col("_id").alias(keys[0]), F.col("_th").alias(keys[1]), F.col("spans").alias(own)), keys, "left").select(*(F.col(f"`{c}`") for c in names), own)
    place = docs.columns.index(text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [bytes(_left(*x)) for x in _trimmed(batch, place, batch.num_columns - 1, True)]
            mask = batch.column(place).is_null().to_numpy(zero_copy_only=False)
            cols = list(batch.columns[:-1])
            cols[place] = pa.array(rest, pa.binary(), mask=mask).cast(pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=list(names))

    return joined.mapInArrow(apply, docs.schema)
