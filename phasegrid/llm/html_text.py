"""Main text of web pages: markup zones first, then differences between pages of neighbouring addresses.

A page becomes lines, one for each block of text, each with its zone: `main` (inside an article or main element), `side` (menus, page
headers and footers, sidebars, notices, adverts, forms, comments, known by element, role or words of class and id) or `open` (any
other). Pages of a host are put in the order of their paths, and each is paired with the nearer of its two neighbours, that with the
longer common beginning of the path. A longest common subsequence aligns the digests of their lines, and open lines that both share
are deleted, unless the two pages are copies of each other: more than half of the open characters shared, or one path. Lines of a
main zone stay when shared, since two articles may quote the same passage; side lines always go. A page with a main zone gives no
open lines.

Only digests travel between pages: a task never holds a host, and the lines that may stay are shuffled once, to meet their page's result.

Defined cases: null html is empty and has no text; a null or unreadable address counts as host and path of its own kind (empty);
repeated rows are one page when pairing and each give a row; ties in nearness go to the earlier neighbour; an empty table gives no
rows; columns with other names are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from os.path import commonprefix
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ranked

# Elements whose text is never shown, elements that end a block, and elements without content.
_UNSEEN = frozenset("script style noscript template iframe object svg math canvas audio video textarea title head xmp".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe svg math textarea title xmp".split())
# Elements, roles, and words of class or id that mark text beside the article.
_SIDE = frozenset("nav footer aside form menu dialog button select".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
_HINTS = frozenset("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr menu modal nav navbar navigation newsletter notice notices overlay paywall popup promo promoted promotion related respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget".split())
_MAIN = frozenset(("article", "main"))
_HEAD = frozenset("base link meta script style title noscript template".split())

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_BLANK = re.compile(r"\s+")
MAIN, OPEN, SIDE = 0, 1, 2


def lines_of(page: str) -> list[tuple[str, int]]:
    """The text of each block of a page with its zone."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int, list[str] | None]] = []  # open elements, the zone outside them, and the text of the block that they interrupt
    zone, text, at = OPEN, [], 0

    def end() -> None:
        line = _BLANK.sub(" ", html.unescape("".join(text))).strip() if text else ""
        if line:
            out.append((line, zone))
        text.clear()

    def leave(depth: int) -> None:
        nonlocal zone, text
        end()
        while len(stack) > depth:
            _, zone, held = stack.pop()
            if held is not None:
                text = held
                if len(stack) > depth:
                    end()

    def innermost(names: frozenset[str]) -> int:
        return next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in names), -1)

    while found := _MARKUP.search(page, at):
        if found.start() > at:
            text.append(page[at : found.start()])
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        block = name in _BLOCK
        if found[1] or found[4]:
            depth = innermost(frozenset((name,)))
            if depth >= 0 and (block or depth > innermost(_BLOCK)):
                if block or any(held is not None or was != zone for _, was, held in stack[depth:]):
                    leave(depth)
                else:
                    del stack[depth:]
            if block:
                end()
            continue
        if stack and stack[-1][0] == "head" and name not in _HEAD:
            leave(len(stack) - 1)  # the body has begun
        if name in _RAW:
            close = re.compile(rf"</{re.escape(name)}(?![^\s/>])", re.I).search(page, at)
            past = page.find(">", close.start()) if close else -1
            at = len(page) if past < 0 else past + 1
            continue
        if block:
            end()
            depth = innermost(_BLOCK)
            if depth >= 0 and (stack[depth][0] == "p" or (name == stack[depth][0] and name in ("li", "dt", "dd", "option"))):
                leave(depth)
        elif name in ("br", "td", "th"):
            text.append(" ")
        if name in _VOID:
            continue
        inner = _inside(name, found[3] if found[3] is not None else found[6] or "", zone)
        held = None
        if inner != zone and not block and inner == SIDE:  # an interruption: the block goes on after it
            held, text = text, []
        elif inner != zone:
            end()
        stack.append((name, zone, held))
        zone = inner
    if at < len(page):
        text.append(page[at:])
    leave(0)
    end()
    return out


def _inside(name: str, attributes: str, zone: int) -> int:
    """Zone inside an element that is opened in `zone`."""
    if zone == SIDE or name in _UNSEEN or name in _SIDE or (name == "header" and zone != MAIN):
        return SIDE
    if attributes and name not in ("html", "body"):
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), (a or b or c).lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true"):
                return SIDE
            if key == "role":
                if value in _ROLES:
                    return SIDE
                if value == "main":
                    zone = MAIN
            elif key in ("class", "id") and name not in _MAIN and not _HINTS.isdisjoint(_WORD.findall(value)):
                return SIDE
            elif key in ("class", "id") and name in _MAIN and not {"comment", "comments", "ad", "ads", "sponsored"}.isdisjoint(_WORD.findall(value)):
                return SIDE
    return MAIN if name in _MAIN else zone


def digest(line: str) -> bytes:
    return hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def common(a: list, b: list, most: int = 1 << 26) -> list[int]:
    """Places in a of one longest common subsequence with b. Rows of bits where the table has up to `most` cells, halves of a beyond."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    both = set(a[low : len(a) - high]) & set(b[low : len(b) - high])
    at = [i for i in range(low, len(a) - high) if a[i] in both]
    x, y = [a[i] for i in at], [v for v in b[low : len(b) - high] if v in both]
    return [*range(low), *(at[i] for i in _aligned(x, y, most)), *range(len(a) - high, len(a))]


def _rows(x: list, y: list) -> Iterator[int]:
    """Bit j of each row is clear where a common subsequence with y[:j + 1] is longer than with y[:j]."""
    where: dict = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    row = full
    for v in x:
        hit = row & where.get(v, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _lengths(x: list, y: list) -> np.ndarray:
    """Length of the longest common subsequence of x with every beginning of y."""
    row = (1 << len(y)) - 1
    for row in _rows(x, y):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def _aligned(x: list, y: list, most: int) -> list[int]:
    if not x or not y:
        return []
    if len(x) > 1 and len(x) * len(y) > most:
        half = len(x) // 2
        cut_at = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
        return _aligned(x[:half], y[:cut_at], most) + [half + i for i in _aligned(x[half:], y[cut_at:], most)]
    rows = list(_rows(x, y))
    out, j = [], len(y) - 1
    for i in range(len(x) - 1, -1, -1):
        # Go left while y[j] adds nothing to x[:i + 1]; then x[i] is used if without it y[j] would add nothing either.
        while j >= 0 and rows[i] >> j & 1:
            j -= 1
        if j < 0:
            break
        if i == 0 or rows[i - 1] >> j & 1:
            out.append(i)
            j -= 1
    return out[::-1]


def _place(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
    except ValueError:
        return "", url or ""
    return parts.netloc.lower(), parts.path


def _key() -> F.Column:
    return F.unhex(F.md5(F.concat_ws("\x00", *(F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in ("page_id", "url", "html")))))


def digests(pages: DataFrame) -> DataFrame:
    """(key, host, path, marks, zones, sizes) of each row: per line its digest of 64 bits and its zone; without a main zone, also the characters of each open line."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, url, page in zip(*(c.to_pylist() for c in batch.columns)):
                found = lines_of(page or "")
                sizes = [] if any(z == MAIN for _, z in found) else [len(t) for t, z in found if z == OPEN]
                rows.append((key, *_place(url), b"".join(digest(t) for t, _ in found), bytes(z for _, z in found), np.array(sizes, np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_LINES.types)], names=_LINES.names)

    return pages.select(_key().alias("key"), "url", "html").mapInArrow(read, "key binary, host string, path string, marks binary, zones binary, sizes binary")


_LINES = pa.schema([("key", pa.binary()), ("host", pa.string()), ("path", pa.string()), ("marks", pa.binary()), ("zones", pa.binary()), ("sizes", pa.binary())])


def nearer(row: tuple, before: tuple | None, after: tuple | None) -> tuple | None:
    """Of the rows (host, path, ...) before and after, that of the same host whose path begins more like this one's; the earlier of equals."""
    before, after = (x if x is not None and x[0] == row[0] else None for x in (before, after))
    if before is None or after is None:
        return before or after
    return before if len(commonprefix([row[1], before[1]])) >= len(commonprefix([row[1], after[1]])) else after


def difference(row: tuple, other: tuple | None) -> tuple[str, int, int]:
    """(1 for each candidate line of row that goes, else 0; number of lines; number shared) for rows (host, path, marks, zones, sizes)."""
    a, b = ([m[i : i + 8] for i in range(0, len(m), 8)] for m in (row[2], other[2] if other else b""))
    hit = np.zeros(len(a), bool)
    hit[common(a, b)] = True
    zone = np.frombuffer(row[3], np.uint8)
    free = zone == OPEN
    gone = free.copy()
    if not (zone == MAIN).any():
        size = np.frombuffer(row[4], np.uint32).astype(np.int64)
        copies = other is not None and (row[1] == other[1] or 2 * size[hit[free]].sum() > size.sum())
        gone = free & hit & (not copies)
    return "".join("01"[x] for x in gone[zone != SIDE].astype(int)), len(a), int(hit.sum())


_FOUND = pa.schema([("at", pa.int64()), ("key", pa.binary()), ("gone", pa.string()), ("n_lines", pa.int64()), ("n_shared", pa.int64())])


def differences(pages: DataFrame) -> DataFrame:
    """(key, gone, n_lines, n_shared) of each distinct page, beside the nearer of its neighbours in the order of host and path.

    Sorted ranges are read once, with a row kept before and after; the first and last of each range meet their neighbours by place.
    """
    one = digests(pages).groupBy("key").agg(*(F.first(c).alias(c) for c in ("host", "path", "marks", "zones", "sizes")))
    placed, _ = ranked(one, ["host", "path", "key"], "at")
    placed = placed.select("at", "key", "host", "path", "marks", "zones", "sizes")

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, row = None, None  # row has no result yet
        for batch in batches:
            out = []
            for after in zip(*(c.to_pylist() for c in batch.columns)):
                if row is not None:
                    out.append((*row[:2], *(difference(row[2:], nearer(row[2:], before[2:], after[2:])) if before is not None else (None, None, None))))
                before, row = row, after
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_FOUND.types)], names=_FOUND.names)
        if row is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*row[:2], None, None, None), _FOUND.types, strict=True)], names=_FOUND.names)

    shape = "at long, key binary, gone string, n_lines long, n_shared long"
    found = cut(placed.mapInArrow(inner, shape))
    ends = [r.at for r in found.where("gone is null").select("at").collect()]  # two of each range
    near = sorted({i + d for i in ends for d in (-1, 0, 1)})
    few = placed.where(F.col("at").isin(near)) if near else placed.limit(0)
    joined = few.where(F.col("at").isin(ends)) if ends else few
    for name, step in (("before", 1), ("after", -1)):
        joined = joined.join(few.select((F.col("at") + step).alias("at"), F.struct("host", "path", "marks", "zones", "sizes").alias(name)), "at", "left")

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at, key, host, path, marks, zones, sizes, *sides in zip(*(c.to_pylist() for c in batch.columns)):
                row = (host, path, marks, zones, sizes)
                out.append((at, key, *difference(row, nearer(row, *(tuple(x.values()) if x else None for x in sides)))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_FOUND.types)], names=_FOUND.names)

    return found.where("gone is not null").unionByName(joined.select("at", "key", "host", "path", "marks", "zones", "sizes", "before", "after").mapInArrow(outer, shape)).drop("at")


def candidate_lines(pages: DataFrame) -> DataFrame:
    """(key, page_id, url, text): every line that is not beside the article, joined by newlines, which lines do not hold."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(t for t, z in lines_of(page or "") if z != SIDE) for page in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string())], names=["key", "page_id", "url", "text"])

    return pages.select(_key().alias("key"), "page_id", "url", "html").mapInArrow(read, "key binary, page_id long, url string, text string")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_lines, n_shared) of every page; n_shared counts its lines found in the paired page too."""
    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    texts = candidate_lines(pages).groupBy("key").agg(F.count(F.lit(1)).alias("_n"), *(F.first(c).alias(c) for c in ("page_id", "url", "text")))
    lines = F.arrays_zip(F.split("text", "\n").alias("line"), F.split("gone", "").alias("gone"))
    kept = F.transform(F.filter(lines, lambda x: x["gone"] == "0"), lambda x: x["line"])
    out = texts.join(differences(pages), "key").withColumn("text", F.array_join(kept, "\n"))
    each = F.explode(F.array_repeat(F.struct("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_lines", "n_shared"), F.col("_n").cast("int"))).alias("_p")
    return out.select(each).select("_p.*")
