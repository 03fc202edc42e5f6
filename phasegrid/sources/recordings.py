"""Readers and writers. Text exports are read by Spark's own text source, one table for what was a sheet."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import normal_names, number


def read_sheet(spark: SparkSession, path: str, schema: str | None = None, id_column: str | None = "id", header: bool = True) -> DataFrame:
    """A CSV or Parquet table with regular names; rows whose id is no number are dropped, ids become long."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        reader = spark.read.option("header", header).option("encoding", "UTF-8")
        df = (reader.schema(schema) if schema else reader).csv(path)
    df = normal_names(df)
    if id_column and id_column in df.columns:
        df = df.withColumn(id_column, number(F.col(id_column)).cast("long")).where(F.col(id_column).isNotNull())
    return df


def read_excel(path: str, sheet: str | int = 0, header: int = 0):
    """A workbook's sheet as pandas, where openpyxl is at hand; otherwise export the sheet and use read_sheet."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise ImportError("openpyxl is not installed: export each sheet to CSV or Parquet and use read_sheet") from e
    import pandas as pd

    return pd.read_excel(path, sheet_name=sheet, header=header)


def read_sheets(spark: SparkSession, folder: str, expected: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Tables of the scenarios {segment: (pair, phase, window)} under folder/<segment>.parquet, joined end to end with these columns."""
    out = None
    for segment, (pair, phase, window) in expected.items():
        df = normal_names(spark.read.parquet(f"{folder}/{segment}.parquet"))
        df = df.withColumns({"segment": F.lit(segment), "pair": F.lit(pair), "phase": F.lit(phase), "window": F.lit(window)})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def file_parts(name: Column) -> dict[str, Column]:
    """Subject and condition from `subject_name_condition.ext`: the first and the last part."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"\.[^.]*$", "")
    parts = F.split(stem, "_")
    return {"subject": F.element_at(parts, 1), "condition": F.upper(F.element_at(parts, -1))}


def read_exports(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(subject, condition, channel, description, t_sec, value, status) of tab-separated exports.

    A file has a row of names that starts with `sec`, then a row of channel descriptions, then numbers. Rows with another
    number of cells or no time are dropped. A file without the header gives one row with its reason and no values.
    """
    text = spark.read.option("pathGlobFilter", glob).text(path)
    name = F.regexp_replace(F.col("_metadata.file_path"), "%20", " ")
    lines = text.select(name.alias("file"), F.regexp_replace("value", "^﻿", "").alias("line"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i"))
    cells = lines.withColumn("cells", F.split("line", "\t"))
    head = cells.where(F.lower(F.trim(F.col("cells")[0])) == "sec").groupBy("file").agg(F.min(F.struct("i", "cells")).alias("h"))
    files = lines.select("file").distinct().join(head, "file", "left")
    after = cells.join(head, "file").where(F.col("i") > F.col("h.i"))
    notes = after.groupBy("file").agg(F.min(F.struct("i", "cells")).alias("d"))
    rows = after.join(notes, "file").where((F.col("i") > F.col("d.i")) & (F.size("cells") == F.size("h.cells")) & number(F.col("cells")[0]).isNotNull())
    value = F.posexplode(F.slice("cells", 2, 1 << 20)).alias("k", "cell")
    long = rows.select("file", number(F.col("cells")[0]).alias("t_sec"), F.col("h.cells").alias("names"), F.col("d.cells").alias("notes"), value)
    got = long.select("file", F.get("names", F.col("k") + 1).alias("channel"), F.trim(F.get("notes", F.col("k") + 1)).alias("description"), "t_sec", number(F.col("cell")).alias("value"), F.lit("ok").alias("status"))
    missing = files.where("h is null").select("file", *(F.lit(None).cast(t).alias(c) for c, t in (("channel", "string"), ("description", "string"), ("t_sec", "double"), ("value", "double"))), F.lit("no header row").alias("status"))
    parts = file_parts(F.col("file"))
    return got.unionByName(missing).select(parts["subject"].alias("subject"), parts["condition"].alias("condition"), "channel", "description", "t_sec", "value", "status")


def channel(df: DataFrame, word: str) -> DataFrame:
    """Rows of channels whose description holds the word."""
    return df.where(F.col("description").contains(word))


def joined_halves(front: DataFrame, back: DataFrame, length: float = 600.0) -> DataFrame:
    """Two halves of a recording on one clock: of each the rows before `length` seconds, the second moved by it. Both must have the same columns."""
    if len(front.columns) != len(back.columns):
        raise ValueError(f"{len(front.columns)} and {len(back.columns)} columns")
    keep = lambda df, by: df.where(F.col("t_sec") < length).withColumn("t_sec", F.col("t_sec") + by)
    return keep(front, 0.0).unionByName(keep(back.toDF(*front.columns), length))


# ---- sinks ----


def write_tables(tables: dict[str, DataFrame], folder: str, form: str = "parquet", **options) -> None:
    """One table for what was a sheet: "parquet", "csv" (with header), "tsv" or "json"."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite").options(**options)
        if form in ("csv", "tsv"):
            writer.option("header", True).option("sep", "\t" if form == "tsv" else ",").csv(f"{folder}/{name}")
        else:
            writer.format(form).save(f"{folder}/{name}")


def append_row(spark: SparkSession, path: str, values: dict, schema: str) -> None:
    """Add one row to a manifest or run log; earlier rows are never rewritten."""
    spark.createDataFrame([tuple(values[x.split()[0]] for x in schema.split(", "))], schema).coalesce(1).write.mode("append").parquet(path)


def latest(manifest: DataFrame, value: str, at: str = "created_at") -> DataFrame:
    return manifest.agg(F.max_by(value, at).alias(value), F.max(at).alias(at))


def log_run(spark: SparkSession, folder: str, run: str, params: dict, metrics: dict, config: dict | None = None, metadata: dict | None = None, parent: str | None = None, created_at: str | None = None) -> None:
    """Append a run to the tables under folder: runs (run, parent, created_at, config, metadata), run_params and run_metrics (run, name, value)."""
    at = created_at or datetime.now(timezone.utc).isoformat(timespec="seconds")
    text = lambda x: json.dumps(x or {}, sort_keys=True, default=str, ensure_ascii=False)
    add = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
    add([(run, parent, at, text(config), text(metadata))], "run string, parent string, created_at string, config string, metadata string", "runs")
    add([(run, k, str(v)) for k, v in params.items()], "run string, name string, value string", "run_params")
    add([(run, k, None if v is None else float(v)) for k, v in metrics.items()], "run string, name string, value double", "run_metrics")
    for group in {None, parent}:
        point_to(spark, folder, run, group)


def _pointers(spark: SparkSession, folder: str, parent: str | None):
    """(file system, folder of pointers as a path, [(version, path)] by version). A pointer is an empty file named <version>-<name in hex>."""
    jvm = spark._jvm
    name = "all" if parent is None else "of-" + parent.encode().hex()
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/_latest/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    if fs.exists(path):
        for status in fs.listStatus(path):
            version, _, run = status.getPath().getName().partition("-")
            if version.isdigit():
                found.append((int(version), status.getPath(), bytes.fromhex(run).decode()))
    return fs, path, sorted(found, key=lambda x: (x[0], x[2]))


def point_to(spark: SparkSession, folder: str, run: str, parent: str | None = None, kept: int = 8) -> int:
    """Make `run` the latest one (of a parent) and return the pointer's version. The pointer is written beside and renamed into the next
    version, so a reader sees the old or the new one; the last `kept` versions stay."""
    import uuid

    jvm = spark._jvm
    fs, path, found = _pointers(spark, folder, parent)
    version = found[-1][0] + 1 if found else 1
    beside = jvm.org.apache.hadoop.fs.Path(path, f"_new-{uuid.uuid4().hex}")
    fs.create(beside, True).close()
    while not fs.rename(beside, jvm.org.apache.hadoop.fs.Path(path, f"{version:012d}-{run.encode().hex()}")):
        version += 1
    for _, old, _ in found[: max(len(found) + 1 - kept, 0)]:
        fs.delete(old, False)
    return version


def latest_run(spark: SparkSession, folder: str, parent: str | None = None) -> str | None:
    """The run logged last (among those of a parent): by the pointer, or where none was written by the time stamps."""
    found = _pointers(spark, folder, parent)[2]
    if found:
        return found[-1][2]
    runs = spark.read.parquet(f"{folder}/runs")
    return latest(runs.where(F.col("parent") == parent) if parent else runs, "run").first()[0]


def label_sets(labels: DataFrame) -> DataFrame:
    """(key, model, k, kind) of the partitions in a label table, read from keys such as gmm_k3_full."""
    key = F.col("key")
    part = lambda n: F.regexp_extract(key, r"^([a-z]+)_k(\d+)(?:_(\w+))?$", n)
    return labels.select("key").distinct().select("key", part(1).alias("model"), part(2).try_cast("int").alias("k"), F.when(part(3) != "", part(3)).alias("kind"))


def feature_metadata(spark: SparkSession, rows: dict[str, tuple[str, str, str]]) -> DataFrame:
    """(feature, source, representing, target): what stood in three header rows above the data."""
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], "feature string, source string, representing string, target string")


def variable_groups(spark: SparkSession, groups: dict[str, list[str]]) -> DataFrame:
    """(feature, block): each variable with its group; one that several groups name raises."""
    rows = [(f, g) for g, names in groups.items() for f in names]
    if len({f for f, _ in rows}) < len(rows):
        raise ValueError("a variable stands in two groups")
    return spark.createDataFrame(rows, "feature string, block string")


def block_file(manifest: DataFrame, block: str) -> str:
    """The path of a block's correlation table by the manifest (block, path, ...); KeyError if it has none."""
    found = manifest.where(F.lower(F.trim("block")) == block.strip().lower()).select("path").first()
    if found is None:
        raise KeyError(block)
    return found[0]


def read_config(path: str | None, overrides: list[str] = (), base: dict | None = None) -> dict:
    """A configuration: base, then the file (YAML if PyYAML is there, else JSON), then overrides such as a.b=3; values are read as JSON where they are."""
    out = dict(base or {})
    if path:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        try:
            import yaml

            own = yaml.safe_load(text) or {}
        except ImportError:
            own = json.loads(text)
        out = merged_config(out, own)
    for item in overrides:
        name, _, value = item.partition("=")
        try:
            value = json.loads(value)
        except ValueError:
            pass
        for part in reversed(name.split(".")):
            value = {part: value}
        out = merged_config(out, value)
    return out


def config_hash(config: dict) -> str:
    """Ten characters that stand for a configuration."""
    return hashlib.md5(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:10]


def merged_config(base: dict, over: dict) -> dict:
    """base with the values of over; mappings merge key by key."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
