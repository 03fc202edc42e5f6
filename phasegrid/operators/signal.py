"""Recordings in the long form (subject, condition, channel, t_sec, value). Each recording is one group of bounded length; all else stays relational."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import waves as w
from ..functions.convex import decompose_many

# Gates and bands of the domain.
REJECT_SNR, STRONG_SNR, MEDIUM_SNR = -25.0, -15.0, -10.0
LF, HF = (0.04, 0.15), (0.15, 0.40)
#: By class of the signal: filter order, high-pass and low-pass frequency, and the share of the recording that the smoother's window takes.
FILTERS = {"strong": (5, 1.0, 35.0, 10), "medium": (4, 0.7, 40.0, 15), "standard": (4, 0.5, 40.0, 20)}
KEYS = ["subject", "condition"]


#: Samples of recordings, about, that a task hands to a kernel at once.
SAMPLES = 1 << 18


def per_recording(df: DataFrame, keys: list[str], schema: str, kernel: Callable[[np.ndarray, np.ndarray], dict | None], time: str = "t_sec", value: str = "value") -> DataFrame:
    """One row for each recording: keys, the kernel's values by name, and a status; a kernel that raises ValueError gives its reason."""

    def each(recordings: list[tuple[np.ndarray, np.ndarray]]) -> list[dict | ValueError | None]:
        out = []
        for t, x in recordings:
            try:
                out.append(kernel(t, x))
            except ValueError as e:
                out.append(e)
        return out

    held = df.select(*keys, time, value).groupBy(*keys).agg(held_samples(time, value))
    return measured(held, schema, each)


def held_samples(time: str, value: str) -> Column:
    """The samples of one recording, whose length is bounded, as one value for measured()."""
    return F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).cast("double").alias("x"))).alias("_samples")


def measured(held: DataFrame, schema: str, kernel: Callable[[list[tuple[np.ndarray, np.ndarray]]], list[dict | ValueError | None]]) -> DataFrame:
    """held with the kernel's values by name and a status in place of `_samples`; the kernel is given many recordings at once, each in order of time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    names = [x.split()[0] for x in schema.split(", ")]
    kept = [c for c in held.columns if c != "_samples"]
    kinds = dict(held.dtypes)
    out = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), schema, "status string"])
    target = to_arrow_schema(_parse_datatype_string(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.asarray(batch.column(batch.schema.get_field_index("_samples")).offsets)
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + SAMPLES, "right")) - 1)
                yield some(batch.slice(first, last - first))
                first = last

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(batch.schema.get_field_index("_samples"))
        flat, size = lists.flatten(), np.asarray(lists.value_lengths())
        t, x = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("t", "x"))
        order = np.lexsort((t, np.repeat(np.arange(len(size)), size)))
        t, x = t[order], x[order].astype(float)
        fine = np.isfinite(x)
        ends = np.r_[0, np.cumsum(size)]
        got = kernel([(t[a:b][fine[a:b]], x[a:b][fine[a:b]]) for a, b in zip(ends, ends[1:])])
        status = [str(g) if isinstance(g, ValueError) else "ok" for g in got]
        got = [{} if g is None or isinstance(g, ValueError) else g for g in got]
        columns = [batch.column(batch.schema.get_field_index(c)) for c in kept] + [pa.array([g.get(n) for g in got], target.field(n).type) for n in names] + [pa.array(status)]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target)], schema=target)

    return held.mapInArrow(run, out)


def rate(t: np.ndarray, fallback: float | None = None) -> float:
    if len(t) < 2 or t[-1] <= t[0]:
        if fallback is None:
            raise ValueError("no sampling rate")
        return fallback
    return float(round((len(t) - 1) / (t[-1] - t[0]))) or (len(t) - 1) / (t[-1] - t[0])


def snr_class(snr: Column) -> Column:
    return F.when(snr < REJECT_SNR, "reject").when(snr < STRONG_SNR, "strong").when(snr < MEDIUM_SNR, "medium").otherwise("standard")


def signal_to_noise(x: np.ndarray, fs: float) -> float:
    """Power of 5-40 Hz over that of drift and hum, in decibels."""
    f, p = np.fft.rfftfreq(len(x), 1 / fs), np.abs(np.fft.rfft(x)) ** 2
    mean = lambda m: p[m].mean() if m.any() else 0.0
    return float(10 * np.log10(mean((f >= 5) & (f <= 40)) / (mean((f >= 0.5) & (f < 3) | (f > 45) & (f < 100)) + 1e-10) + 1e-300))


def clean_rr(rr: np.ndarray) -> np.ndarray:
    """Intervals of 300-2000 ms (250-2500 where that keeps under 60 %), then within 3 scaled deviations of the median unless under ten stay."""
    ok = rr[(rr >= 300) & (rr <= 2000)]
    if len(ok) < 0.6 * len(rr):
        ok = rr[(rr >= 250) & (rr <= 2500)]
    if not len(ok):
        return ok
    gap = np.abs(ok - np.median(ok))
    near = ok[gap <= 3 * 1.4826 * np.median(gap)]
    return near if len(near) >= 10 else ok


def quality(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, fs, snr, drift, kurtosis, max_abs, sd, filter_class, status) of a heart recording."""

    def kernel(t: np.ndarray, x: np.ndarray) -> dict:
        fs = rate(t, 250.0)
        if len(x) < 16:
            raise ValueError("too few samples")
        z = (x - x.mean()) / (x.std() or 1.0)
        return {"fs": fs, "snr": signal_to_noise(x, fs), "drift": w.savitzky_golay(x, min(501, len(x) - 1 | 1)).std(), "kurtosis": (z**4).mean(), "max_abs": np.abs(x).max(), "sd": x.std()}

    out = per_recording(df, keys, "fs double, snr double, drift double, kurtosis double, max_abs double, sd double", kernel)
    return out.withColumn("filter_class", F.when(F.col("snr").isNotNull(), snr_class(F.col("snr"))))


def r_peaks(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, i, t_sec, method, filter_class) of the beats, from the detector that finds most; of equals the gradient detector comes first.

    The class of the signal chooses the filters. Signals below the reject limit, recordings of under ten beats or under twenty cleaned intervals have a status instead.
    """

    def kernel(t: np.ndarray, x: np.ndarray) -> dict:
        fs = rate(t, 250.0)
        if len(x) < 4 * fs:
            raise ValueError("shorter than four seconds")
        snr = signal_to_noise(x, fs)
        if snr < REJECT_SNR:
            raise ValueError("signal too weak")
        kind = "strong" if snr < STRONG_SNR else "medium" if snr < MEDIUM_SNR else "standard"
        order, high, low, share = FILTERS[kind]
        y = w.filtered(x, fs, "high", (high,), order, both_ways=False)
        for hum in (50.0, 60.0):
            if hum + 2 < fs / 2 - 1:  # a band cut off by the end of the spectrum would ring
                y = w.filtered(y, fs, "stop", (hum - 2, hum + 2), 4, both_ways=False)
        y = w.filtered(y, fs, "band", (5.0, min(low, fs * 0.45)), order // 2)  # both ways: the steepness of `order` without its ringing behind each beat
        if len(y) > 51:
            y = w.savitzky_golay(y, max(5, min(len(y) // share * 2 + 1, int(101 * min(1.0, fs / 1000)) | 1)), 2)  # 101 samples at 1000 Hz
        y = (y - y.mean()) / (y.std() or 1.0)
        found = {"gradient": w.gradient_peaks(y, fs)} | {f"peaks {s}": w.peaks(y, distance=int(0.4 * fs), prominence=s) for s in (0.15, 0.30, 0.5)} | {"slope energy": w.pan_tompkins(y, fs)}
        best = max(found, key=lambda k: len(found[k]))
        beats = t[found[best]]
        if len(beats) < 10:
            raise ValueError("fewer than ten beats")
        if len(clean_rr(1000 * np.diff(beats))) < 20:
            raise ValueError("fewer than twenty cleaned intervals")
        return {"method": best, "filter_class": kind, "beats": beats.tolist()}

    return per_recording(df, keys, "method string, filter_class string, beats array<double>", kernel).select(*keys, "method", "filter_class", "status", F.posexplode_outer("beats").alias("i", "t_sec"))


def intervals(beats: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, t_sec, rr): distances of successive beats in ms."""
    from .series import difference

    return beats.where("t_sec is not null").withColumn("rr", 1000 * difference(F.col("t_sec"), keys, ["t_sec"])).where("rr is not null")


def heart_minutes(rr: DataFrame, keys: list[str] = KEYS, minutes: int = 20) -> DataFrame:
    """Time-domain measures for each minute, null rows for minutes with fewer than five beats in 300..2000 ms."""
    from .series import variability

    ok = rr.where(F.col("rr").between(300, 2000)).withColumn("minute", (F.floor(F.col("t_sec") / 60) + 1).cast("int")).where(F.col("minute").between(1, minutes))
    grid = rr.select(*keys).distinct().withColumn("minute", F.explode(F.sequence(F.lit(1), F.lit(minutes))))
    return grid.join(variability(ok, [*keys, "minute"], ["t_sec"]), [*keys, "minute"], "left")


def heart_spectrum(rr: DataFrame, keys: list[str] = KEYS, value: str = "rr") -> DataFrame:
    """(keys, lf, hf, lf_hf, lf_nu, hf_nu): band powers of the intervals at 4 Hz; null below 15 intervals or ten seconds."""

    def kernel(t: np.ndarray, x: np.ndarray) -> dict:
        at = np.cumsum(x) / 1000
        if len(x) < 15 or at[-1] - at[0] < 10:
            raise ValueError("too short for a spectrum")
        grid = np.arange(at[0], at[-1], 0.25)
        y = np.interp(grid, at, x)
        f, p = w.welch(y - y.mean(), 4.0)
        lf, hf = w.band_power(f, p, *LF), w.band_power(f, p, *HF)
        return {"lf": lf, "hf": hf, "lf_hf": lf / hf if hf else None, "lf_nu": 100 * lf / (lf + hf) if lf + hf else None, "hf_nu": 100 * hf / (lf + hf) if lf + hf else None}

    return per_recording(rr, keys, "lf double, hf double, lf_hf double, lf_nu double, hf_nu double", kernel, value=value)


def skin_parts(df: DataFrame, keys: list[str] = KEYS, target: float = 10.0, convex: bool = True) -> DataFrame:
    """(keys, t_sec, tonic, phasic, method) at 10 Hz of a skin conductance recording.

    Tried in turn: the convex programme (functions.convex) on the signal brought to [0, 1], then filters, of which the first whose fast
    part has energy is taken: 0.5 Hz, 0.1 Hz, polynomial, moving average, none. Where the programme breaks down, does not converge or finds
    no energy, the filters decide; `method` names what was taken. With convex=False only the filters are tried.
    """

    def prepared(t: np.ndarray, x: np.ndarray) -> tuple:
        fs = rate(t)
        if len(x) < 4 * fs:
            raise ValueError("shorter than four seconds")
        y = w.filtered(x, fs, "low", (5.0,), 4) if fs > 10 else x
        step = max(1, int(fs // target))
        y, at = y[::step], t[::step]
        y = np.maximum(y - y.min() + 1e-6, 1e-6)
        scale = 1000.0 if np.ptp(y) < 0.01 else 100.0 if np.ptp(y) < 0.1 else 1.0
        return at, np.clip((y - y.min()) / (np.ptp(y) or 1.0), 0.001, 0.999), fs / step, scale

    def parted(at: np.ndarray, z: np.ndarray, scale: float, got: dict | Exception | None) -> dict:
        if isinstance(got, dict):
            fast, slow = np.maximum(got["phasic"], 0.0), np.maximum(got["tonic"], 0.0)
            if np.isfinite(fast).all() and np.isfinite(slow).all() and (fast**2).sum() + (slow**2).sum() >= 1e-10:
                return {"method": "convex", "scale": scale, "t": at, "tonic": slow, "phasic": fast}
        for method, tonic in (("low 0.5 Hz", lambda: w.filtered(z, target, "low", (0.5,), 2)), ("low 0.1 Hz", lambda: w.filtered(z, target, "low", (0.1,), 2)), ("polynomial", lambda: w.savitzky_golay(z, 101)), ("moving average", lambda: w.moving_average(z, 50)), ("none", lambda: z)):
            slow = tonic()
            fast = z - slow
            if (fast**2).sum() >= 1e-10 or method == "none":
                return {"method": method, "scale": scale, "t": at, "tonic": slow, "phasic": fast}
        return {}

    def kernel(recordings: list[tuple[np.ndarray, np.ndarray]]) -> list[dict | ValueError]:
        """Recordings of one length and rate go through the programme together."""
        ready, alike = [], {}
        for r, (t, x) in enumerate(recordings):
            try:
                ready.append(prepared(t, x))
                alike.setdefault((len(ready[r][1]), ready[r][2]), []).append(r)
            except ValueError as e:
                ready.append(e)
        found = [None] * len(ready)
        for (_, fs), rows in alike.items() if convex else ():
            for r, got in zip(rows, decompose_many(np.stack([ready[r][1] for r in rows]), fs)):
                found[r] = got
        out = []
        for x, got in zip(ready, found):
            try:
                out.append(x if isinstance(x, ValueError) else parted(x[0], x[1], x[3], got))
            except ValueError as e:
                out.append(e)
        return out

    got = measured(df.groupBy(*keys).agg(held_samples("t_sec", "value")), "method string, scale double, t array<double>, tonic array<double>, phasic array<double>", kernel)
    rows = F.explode_outer(F.arrays_zip("t", "tonic", "phasic")).alias("_s")
    return got.select(*keys, "method", "status", rows).select(*keys, "method", "status", F.col("_s.t").alias("t_sec"), "_s.tonic", "_s.phasic")


def skin_measures(parts: DataFrame, keys: list[str] = KEYS, first: float = 0.0, last: float = 600.0) -> DataFrame:
    """(keys, tonic_slope, phasic_mean, phasic_sd, phasic_max, derivative_sd, n_peaks, peak_mean) in [first, last): peaks stand at least 0.05 high and ten samples apart."""
    from pyspark.sql import Window

    o = Window.partitionBy(*keys).orderBy("t_sec")
    rows = parts.where((F.col("t_sec") >= first) & (F.col("t_sec") < last))
    rows = rows.withColumn("_d", F.col("phasic") - F.lag("phasic").over(o))
    rows = rows.withColumn("_i", F.row_number().over(o))
    # One pass: the samples go along with the aggregates, so the parts are made once.
    most = rows.groupBy(*keys).agg(F.regr_slope("tonic", "_i").alias("tonic_slope"), F.avg("phasic").alias("phasic_mean"), F.stddev_pop("phasic").alias("phasic_sd"), F.max("phasic").alias("phasic_max"), F.stddev_pop("_d").alias("derivative_sd"), held_samples("t_sec", "phasic"))

    def kernel(recordings: list[tuple[np.ndarray, np.ndarray]]) -> list[dict]:
        tops = [x[w.peaks(x, height=0.05, distance=10)] for _, x in recordings]
        return [{"n_peaks": len(x), "peak_mean": float(x.mean()) if len(x) else None} for x in tops]

    return measured(most, "n_peaks long, peak_mean double", kernel).drop("status")


def method_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n_recordings): how often each method, class or status occurred, for the run's log."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns))
    return rows.select(F.explode(pairs).alias("_p")).groupBy("_p.column", "_p.value").agg(F.count(F.lit(1)).alias("n_recordings"))


def long_enough(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(keys, n, status): recordings of fewer samples are rejected."""
    n = df.groupBy(*keys).agg(F.count("value").alias("n"))
    return n.withColumn("status", F.when(F.col("n") < least, F.format_string("shorter than %d samples", F.lit(least))).otherwise("ok"))


def resampled(df: DataFrame, keys: list[str], hertz: float, least: int = 4) -> DataFrame:
    """(keys, i, value) at another rate, by the Fourier method."""

    def kernel(t: np.ndarray, x: np.ndarray) -> dict:
        n = int(round((t[-1] - t[0] + 1 / rate(t)) * hertz)) if len(t) > 1 else 0
        if n < least:
            raise ValueError("too short to resample")
        return {"x": w.fourier_resample(x, n).tolist()}

    return per_recording(df, keys, "x array<double>", kernel).select(*keys, "status", F.posexplode_outer("x").alias("i", "value"))
