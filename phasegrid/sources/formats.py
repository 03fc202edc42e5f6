"""Two data sources of Spark: "signal_export" reads tab-separated exports in byte ranges, "signal_arrays" reads and writes one .npy array a signal.

    register(spark)
    spark.read.format("signal_export").load(folder)
    write_arrays(df, folder, ["subject", "condition"], "t_sec")

Paths are those that pyarrow.fs opens (a shared folder, hdfs://, s3://, ...); executors must see the same store as the driver.
"""

from __future__ import annotations

import io
import re
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

EXPORT_SCHEMA = "subject string, condition string, channel string, description string, t_sec double, value double, status string"
ARRAY_SCHEMA = "name string, i long, value double"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"\w[\w+.-]*:", path) else (pafs.LocalFileSystem(), path)


def _files(path: str, ending: str) -> list[pafs.FileInfo]:
    """Files with this ending (or the file itself), by name; hidden ones and those being written are left out."""
    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [info]
    found = store.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True))
    return sorted((f for f in found if f.type == pafs.FileType.File and f.path.endswith(ending) and not re.search(r"(^|/)[._]", f.path[len(at.rstrip("/")) :])), key=lambda f: f.path)


@dataclass
class Range(InputPartition):
    """Bytes (or items) [start, end) of a file, with what its header tells."""

    path: str
    start: int
    end: int
    names: tuple[str, ...] = ()
    told: tuple[str, ...] = ()
    status: str | None = None


def _number(cell: str) -> float | None:
    try:
        x = float(cell)
    except ValueError:
        return None
    return x if np.isfinite(x) else None


class ExportReader(DataSourceReader):
    """Rows of each channel. A file has a row of names that starts with `sec`, then a row of descriptions, then numbers; lines with another
    number of cells or without a time are dropped; a file without the header gives one row with its reason. The header is looked for once,
    in the first head_bytes of a file; the rest is read in ranges of range_bytes, each from the first line that begins in it."""

    def __init__(self, options: dict):
        self.path, self.ending = options["path"], options.get("ending", ".txt")
        self.size, self.head = int(options.get("range_bytes", 64 << 20)), int(options.get("head_bytes", 1 << 20))

    def partitions(self) -> list[Range]:
        out = []
        for info in _files(self.path, self.ending):
            store, _ = _store(self.path)
            with store.open_input_file(info.path) as f:
                head = f.read(min(self.head, info.size))
            lines, at, names = head.split(b"\n"), 0, None
            for i, line in enumerate(lines[:-1]):
                cells = line.decode("utf-8-sig", "replace").rstrip("\r").split("\t")
                at += len(line) + 1
                if cells[0].strip().lower() == "sec":
                    names = tuple(c.strip() for c in cells)
                    told = lines[i + 1].decode("utf-8", "replace").rstrip("\r").split("\t")
                    at += len(lines[i + 1]) + 1
                    break
            if names is None:
                out.append(Range(info.path, 0, 0, status="no header line"))
                continue
            told = tuple(c.strip() for c in told) + ("",) * len(names)
            if at >= info.size:
                out.append(Range(info.path, 0, 0, status="no samples"))
            out += [Range(info.path, s, min(s + self.size, info.size), names, told[: len(names)]) for s in range(at, info.size, self.size)]
        return out

    def read(self, part: Range) -> Iterator[tuple]:
        stem = part.path.rsplit("/", 1)[-1].rsplit(".", 1)[0].split("_")
        subject, condition = stem[0], stem[-1].upper()
        if part.status:
            yield subject, condition, None, None, None, None, part.status
            return
        store, _ = _store(self.path)
        with store.open_input_file(part.path) as f:
            # A line belongs to the range in which it begins.
            f.seek(part.start - 1)
            lines = io.BufferedReader(f, 1 << 16)
            at = part.start
            if lines.read(1) != b"\n":
                at += len(lines.readline())
            while at < part.end:
                line = lines.readline()
                if not line:
                    break
                at += len(line)
                cells = line.decode("utf-8", "replace").rstrip("\r\n").split("\t")
                if len(cells) != len(part.names) or (t := _number(cells[0])) is None:
                    continue
                for name, told, cell in zip(part.names[1:], part.told[1:], cells[1:]):
                    yield subject, condition, name, told, t, _number(cell), "ok"


class SignalExport(DataSource):
    """spark.read.format("signal_export"): see ExportReader. Options: path, ending, range_bytes, head_bytes."""

    @classmethod
    def name(cls) -> str:
        return "signal_export"

    def schema(self) -> str:
        return EXPORT_SCHEMA

    def reader(self, schema) -> ExportReader:
        return ExportReader(dict(self.options))


class ArrayReader(DataSourceReader):
    """(name, i, value) of one-dimensional .npy files, in ranges of range_items."""

    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("range_items", 8 << 20))

    def partitions(self) -> list[Range]:
        out = []
        for info in _files(self.path, ".npy"):
            with _store(self.path)[0].open_input_file(info.path) as f:
                shape, _, _ = _npy_header(f)
            out += [Range(info.path, s, min(s + self.size, shape[0])) for s in range(0, shape[0], self.size)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        name = part.path.rsplit("/", 1)[-1].removesuffix(".npy")
        with _store(self.path)[0].open_input_file(part.path) as f:
            _, kind, at = _npy_header(f)
            for s in range(part.start, part.end, 1 << 16):
                n = min(1 << 16, part.end - s)
                f.seek(at + s * kind.itemsize)
                x = np.frombuffer(f.read(n * kind.itemsize), kind).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(s, s + n)), pa.array(x)], names=["name", "i", "value"])


def _npy_header(f) -> tuple[tuple[int, ...], np.dtype, int]:
    """(shape, type, place of the first item) of an array file."""
    raw = io.BytesIO(f.read(4096))
    version = np.lib.format.read_magic(raw)
    shape, _, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(raw)
    if len(shape) != 1 or kind.hasobject:
        raise ValueError("not an array of one dimension")
    return shape, kind, raw.tell()


@dataclass
class Written(WriterCommitMessage):
    files: tuple[tuple[str, str], ...]  # (where it was written, where it belongs)


class ArrayWriter(DataSourceArrowWriter):
    """One <name>.npy for each run of rows of one name, in the order given. Files get their names only when all tasks are done; a task holds one signal."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.beside = path, overwrite, f"_writing-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.path)
        store.create_dir(f"{root}/{self.beside}")
        done, name, held = [], None, array("d")

        def put() -> None:
            if name is None:
                return
            if not re.fullmatch(r"[^/\x00]+", name) or name.startswith((".", "_")):
                raise ValueError(f"{name!r} is no name for a file")
            at = f"{root}/{self.beside}/{uuid.uuid4().hex}.npy"
            raw = io.BytesIO()
            np.lib.format.write_array_header_1_0(raw, {"descr": "<f8", "fortran_order": False, "shape": (len(held),)})
            with store.open_output_stream(at) as f:
                f.write(raw.getvalue())
                f.write(memoryview(np.asarray(held, "<f8")).cast("B"))
            done.append((at, f"{root}/{name}.npy"))

        for batch in batches:
            names, values = batch.column("name").to_pylist(), batch.column("value").cast(pa.float64()).to_numpy(zero_copy_only=False)
            edge = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for s, e in zip(edge, edge[1:]):
                if s == e:
                    continue
                if names[s] != name:
                    put()
                    name, held = names[s], array("d")
                held.frombytes(np.ascontiguousarray(values[s:e], "<f8").tobytes())  # a null is NaN
        put()
        return Written(tuple(done))

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        pairs = [p for m in messages if m for p in m.files]
        if len({to for _, to in pairs}) < len(pairs):
            self.abort(messages)
            raise ValueError("a signal is spread over several runs of rows: sort by name first (write_arrays does)")
        if self.overwrite:
            for info in _files(self.path, ".npy"):
                store.delete_file(info.path)
        for at, to in pairs:
            store.move(at, to)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        if store.get_file_info(f"{root}/{self.beside}").type != pafs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.beside}")


class SignalArrays(DataSource):
    """"signal_arrays": one .npy a signal, (name, i, value). Writing takes columns name and value, rows of a name together and in order."""

    @classmethod
    def name(cls) -> str:
        return "signal_arrays"

    def schema(self) -> str:
        return ARRAY_SCHEMA

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ArrayWriter:
        if not {"name", "value"} <= set(schema.names):
            raise ValueError("columns name and value are needed")
        return ArrayWriter(dict(self.options)["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make both sources known to the session."""
    spark.dataSource.register(SignalExport)
    spark.dataSource.register(SignalArrays)


def write_arrays(df: DataFrame, folder: str, keys: list[str], order: str, value: str = "value", suffix: str = "", mode: str = "append") -> None:
    """One array for each signal (keys), named by the keys joined with underscores and a suffix. Nulls become NaN; rows are ordered by `order` (null first)."""
    register(df.sparkSession)
    name = F.concat_ws("_", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys), *([F.lit(suffix)] if suffix else []))
    rows = df.select(name.alias("name"), F.col(order).alias("_at"), F.col(value).cast("double").alias("value"))
    rows.repartition("name").sortWithinPartitions("name", "_at").select("name", "value").write.format("signal_arrays").mode(mode).save(folder)
