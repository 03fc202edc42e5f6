"""Compression bands: zstandard ratios of the whole text and of fixed chunks, with limits that depend on length.

A ratio is bytes over compressed bytes. Repetitive text compresses too well, noise hardly at all. Fixed limits (Bands) hold for texts of
any origin. Besides, ratios grow smoothly with length, and good texts of a language stay close to that curve; so limits are also taken
from all rows: medians of quarter octaves of length for each language, and around them a multiple of the median deviation, which junk of
up to a fair share does not move. Copies count once there. Word counts and the base rules come from the same pass over each text.

Defined cases: a null or empty text has no words and fails the base rules; repeated rows are judged each; a null language is a language;
tables and languages with few texts use the curve of all languages, or the fixed limits alone; an empty table gives no rows; columns with
other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, cut, hashed, mix, slices, sums, words


@dataclass(frozen=True)
class Bands:
    """Limits by length: row i holds for texts of up to upto[i] bytes (the last for all longer ones)."""

    upto: tuple[int, ...] = (128, 256, 512, 1024, 2048, 4096, 8192, 16384, 1 << 62)
    #: Least and most ratio of the whole text.
    least: tuple[float, ...] = (0.50, 0.90, 1.15, 1.30, 1.45, 1.55, 1.60, 1.65, 1.70)
    most: tuple[float, ...] = (1.9, 2.5, 2.5, 2.6, 2.7, 2.8, 2.9, 3.0, 3.2)
    chunk: int = 2048
    #: Most ratio of any chunk of full length, and least ratio of any such chunk.
    chunk_most: float = 3.0
    chunk_least: float = 1.45
    level: int = 3
    #: Length of the chunks that are held against the learned curve, and how many deviations above and below it the whole and the highest chunk may lie.
    short_chunk: int = 512
    above: tuple[float, float] = (4.5, 5.0)
    below: tuple[float, float] = (6.5, 8.5)
    #: Distinct texts that a quarter octave needs to count, and the least deviation.
    texts: int = 20
    floor: float = 0.008


def repeats(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For (row, key) pairs: true where the same pair occurs more than once."""
    if not len(keys):
        return np.zeros(0, bool)
    both = mix(keys ^ mix(rows.astype(np.uint64) + np.uint64(0x51ED2701)))
    order = np.argsort(both, kind="stable")
    same = both[order][1:] == both[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def text_counts(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each row: words, code points in them, symbols, repeated lines, words in repeated 8-word windows."""
    n = len(bounds) - 1
    starts, ends, first = words(data, bounds)
    n_words = np.diff(first)
    rows = np.repeat(np.arange(n), n_words)
    point = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=point[1:])
    chars = sums(point[ends] - point[starts], first)
    symbols = sums(np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8)), bounds)
    # Lines: cut at every \n and at row bounds.
    breaks = np.flatnonzero(data == 10)
    line_from = np.sort(np.r_[bounds[:-1], breaks + 1])
    line_row = np.searchsorted(bounds[1:], line_from, "right")
    # A row's last line may be empty and start where the next row does; order by place, then by row.
    own = np.searchsorted(bounds[1:], breaks, "right")
    line_from, line_row = np.r_[bounds[:-1], breaks + 1], np.r_[np.arange(n), own]
    order = np.lexsort((line_from, line_row))
    line_from, line_row = line_from[order], line_row[order]
    line_to = np.r_[line_from[1:] - 1, 0]
    last = np.r_[line_row[1:] != line_row[:-1], True] if len(line_row) else np.zeros(0, bool)
    line_to[last] = bounds[1:][line_row[last]]
    wordy = np.searchsorted(starts, line_to) > np.searchsorted(starts, line_from)
    keys, of = hashed(data, line_from[wordy], line_to[wordy]), line_row[wordy]
    both = mix(keys ^ mix(of.astype(np.uint64) + np.uint64(77)))
    distinct, at = np.unique(both, return_index=True)
    lines = np.bincount(of, minlength=n) - np.bincount(of[at], minlength=n)
    # Windows of 8 words.
    k = 8
    word = hashed(data, starts, ends)
    repeated = np.zeros(len(starts), np.int64)
    if len(word) >= k:
        window = np.zeros(len(word) - k + 1, np.uint64)
        for j in range(k):
            window = mix(window + word[j : j + len(window)])
        inside = rows[: len(window)] == rows[k - 1 :]
        at = np.flatnonzero(inside)
        twice = at[repeats(window[at], rows[at])]
        np.add.at(repeated, twice, 1)
        delta = np.zeros(len(starts) + 1, np.int64)
        delta[:-1] += repeated
        np.subtract.at(delta, twice + k, 1)
        repeated = (np.cumsum(delta[:-1]) > 0).astype(np.int64)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": sums(repeated, first)}


def ratios(body: memoryview | bytes, bands: Bands, press: zstandard.ZstdCompressor) -> tuple[float, float, float, float]:
    """Ratio of the whole, and the highest, the median and the lowest of full chunks (those of the whole if none is full). The last chunk ends at the text's end."""
    n = len(body)
    if not n:
        return 0.0, 0.0, 0.0, 0.0
    whole = n / len(press.compress(body))
    if n < bands.chunk:
        return whole, whole, whole, whole
    starts = [*range(0, n - bands.chunk + 1, bands.chunk), *([n - bands.chunk] if n % bands.chunk else [])]
    each = sorted(bands.chunk / len(press.compress(body[i : i + bands.chunk])) for i in starts)
    return whole, each[-1], each[len(each) // 2], each[0]


#: Languages are kept apart in this many buckets by hash, so that what the driver holds is bounded.
LANGUAGES = 64
ALL = LANGUAGES
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, reason string, whole_ratio double, chunk_most double, chunk_mid double, chunk_least double"
_MEASURED = "doc_id long, lang int, n_bytes long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, whole_ratio double, chunk_most double, chunk_mid double, chunk_least double, short_most double, mark long"


def least_window(data: np.ndarray, bounds: np.ndarray, k: int = 8) -> np.ndarray:
    """The least hash of k words in a row of each row (of all its words if it has fewer), as near copies mostly share it."""
    starts, ends, first = words(data, bounds)
    word = hashed(data, starts, ends)
    out = np.zeros(len(bounds) - 1, np.uint64)
    for row, (s, e) in enumerate(zip(first[:-1], first[1:])):
        w = word[s:e]
        if len(w):
            window = np.zeros(max(len(w) - k + 1, 1), np.uint64)
            for j in range(min(k, len(w))):
                window = mix(window + w[j : j + len(window)])
            out[row] = window.min()
    return out.view(np.int64)


def measured(docs: DataFrame, bands: Bands, doc_id: str, text: str, lang: str | None) -> DataFrame:
    """_MEASURED of each row of docs: counts, base rules and ratios."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False)
        short = Bands(chunk=bands.short_chunk)
        for whole in batches:
            for batch in slices(whole, "_text"):
                data, bounds = buffers(batch.column("_text"))
                c = text_counts(data, bounds)
                view = memoryview(np.ascontiguousarray(data))
                spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
                r = np.array([ratios(view[s:e], bands, press) for s, e in spans]).reshape(-1, 4)
                most = np.array([ratios(view[s:e], short, press)[1] for s, e in spans]).reshape(-1)
                base = (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
                cols = [batch.column("doc_id"), batch.column("_lang"), pa.array(np.diff(bounds)), *(pa.array(c[x].astype(np.int64)) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(base), *(pa.array(r[:, i]) for i in range(4)), pa.array(most), pa.array(least_window(data, bounds))]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _MEASURED.split(", ")])

    of = F.pmod(F.xxhash64(F.coalesce(F.col(lang).cast("string"), F.lit(""))), F.lit(LANGUAGES)).cast("int") if lang else F.lit(0)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), of.alias("_lang"), F.col(text).alias("_text")).mapInArrow(judge, _MEASURED)


@dataclass
class Curve:
    """Of one language and one ratio: places (log2 of bytes) and medians, and the deviation of each octave."""

    at: np.ndarray
    median: np.ndarray
    spread: dict[int, float]

    def around(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected ratio and deviation at x; beyond the known lengths the deviation widens."""
        beyond = np.maximum(np.maximum(self.at[0] - x, x - self.at[-1]) - 0.25, 0)
        known = np.array([self.spread.get(int(o), np.nan) for o in np.floor(x)])
        usual = max(self.spread.values(), default=1.0)
        return np.interp(x, self.at, self.median), np.where(np.isnan(known), usual, known) + 0.15 * beyond


def _middle(value: np.ndarray, count: np.ndarray) -> float:
    order = np.argsort(value)
    upto = np.cumsum(count[order])
    return float(value[order][np.searchsorted(upto, upto[-1] / 2)])


def learned_curves(rows: DataFrame, bands: Bands) -> dict[tuple[int, int], Curve]:
    """{(language bucket or ALL, 0 whole or 1 chunk): curve} from measured rows that pass the base rules, copies counted once. Histograms of bounded size reach the driver."""
    once = rows.where(~F.col("base_failed") & (F.col("n_bytes") > 0)).groupBy("lang", "mark").agg(F.min_by(F.struct("n_bytes", "whole_ratio", "short_most"), F.struct("n_bytes", "whole_ratio", "short_most")).alias("r"))
    each = F.explode(F.array(*(F.struct(F.col("_l").alias("lang"), F.lit(j).alias("j"), F.col(c).alias("v")) for j, c in enumerate(("r.whole_ratio", "r.short_most"))))).alias("_e")
    x = F.log2(F.col("r.n_bytes").cast("double"))
    long = cut(once.withColumn("_l", F.explode(F.array("lang", F.lit(ALL)))).select(x.alias("x"), each).select("x", "_e.*"))
    cells = long.groupBy("lang", "j", F.floor(F.col("x") * 4).cast("int").alias("cell"), F.round(F.col("v"), 2).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x")).collect()
    held: dict[tuple, dict[int, list]] = {}
    for r in cells:
        held.setdefault((r.lang, r.j), {}).setdefault(r.cell, []).append((r.v, r.n, r.x))
    curves = {}
    for key, own in held.items():
        known = [(sum(x for _, _, x in c) / n, _middle(np.array([v for v, _, _ in c]), np.array([m for _, m, _ in c]))) for _, c in sorted(own.items()) if (n := sum(m for _, m, _ in c)) >= bands.texts]
        if len(known) >= 2:
            curves[key] = Curve(np.array([k[0] for k in known]), np.array([k[1] for k in known]), {})
    if not curves:
        return {}

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, j, x, v = (b.column(c).to_numpy() for c in ("lang", "j", "x", "v"))
            gap = np.full(len(v), np.nan)
            for key, curve in curves.items():
                own = (lang == key[0]) & (j == key[1])
                gap[own] = np.abs(v[own] - np.interp(x[own], curve.at, curve.median))
            some = np.flatnonzero(np.isfinite(gap))
            yield pa.RecordBatch.from_pydict({"lang": lang[some].astype(np.int32), "j": j[some].astype(np.int32), "octave": np.floor(x[some]).astype(np.int32), "gap": np.round(np.minimum(gap[some], 4.0), 3)})

    far: dict[tuple, dict[int, list]] = {}
    for r in long.select("lang", "j", "x", "v").mapInArrow(residuals, "lang int, j int, octave int, gap double").groupBy("lang", "j", "octave", "gap").count().collect():
        far.setdefault((r.lang, r.j), {}).setdefault(r.octave, []).append((r.gap, r["count"]))
    for key, own in far.items():
        spread = {o: 1.4826 * _middle(np.array([g for g, _ in c]), np.array([n for _, n in c])) for o, c in own.items() if sum(n for _, n in c) >= bands.texts}
        usual = float(np.median(list(spread.values()))) if spread else 1.0
        curves[key].spread.update({o: max(s, 0.6 * usual, bands.floor) for o, s in spread.items()})
    return curves


def compression_bands(docs: DataFrame, bands: Bands = Bands(), doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """(doc_id, counts..., base_failed, kept, reason, ratios): one row for each row of docs. lang: a column that parts the curves (None or absent: one curve)."""
    rows = cut(measured(docs, bands, doc_id, text, lang if lang in docs.columns else None))
    curves = learned_curves(rows, bands)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto = np.array(bands.upto)
        for batch in batches:
            n, base, lang_of = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_bytes", "base_failed", "lang"))
            whole, most, least, short = (batch.column(c).to_numpy() for c in ("whole_ratio", "chunk_most", "chunk_least", "short_most"))
            band = np.minimum(np.searchsorted(upto, n), len(upto) - 1)
            high = (whole > np.array(bands.most)[band]) | (most > bands.chunk_most)
            low = (whole < np.array(bands.least)[band]) | (least < bands.chunk_least) & (n >= bands.chunk)
            x = np.log2(np.maximum(n, 1).astype(float))
            for own in np.unique(lang_of).tolist():
                mine = (lang_of == own) & (n > 0)
                for j, v in enumerate((whole, short)):
                    curve = curves.get((own, j)) or curves.get((ALL, j))
                    if curve is not None and mine.any():
                        middle, spread = curve.around(x[mine])
                        high[mine] |= v[mine] > middle + bands.above[j] * spread
                        low[mine] |= v[mine] < middle - bands.below[j] * spread
            reason = np.where(base, "base", np.where(high, "repetitive", np.where(low, "incompressible", "")))
            out = {c: batch.column(c) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")} | {"kept": pa.array(~(base | high | low)), "reason": pa.array(reason)} | {c: batch.column(c) for c in ("whole_ratio", "chunk_most", "chunk_mid", "chunk_least")}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return rows.mapInArrow(judge, SCHEMA)
