"""SentencePiece encoding and decoding by batched Viterbi in numpy.

Texts are cut where no piece crosses; each different unit is solved once for a batch. Units of one length advance together (those above
MANY code points in batches of falling length), one end position at a time: keys of the substrings probe the sorted keys of the pieces, hits are
compared code point by code point, and the predecessor of highest score is stored as back-pointer. For a model of type BPE the score of a
path is the product over its borders: 1 where the merges of both pieces hold side by side (they are stable), else 0. Just one path of
each prefix has score 1, and it is the segmentation by merges. So ids equal those of the SentencePiece library, which plain sums of piece scores would not give.

Only BPE models with identity normalisation, dummy prefix and byte fallback are taken, others raise ValueError. Defined cases: null and empty texts have no ids; U+2581
in a text reads as a blank (as in the library); repeated rows are coded alike; an empty table gives no rows; columns with
other names are ignored unless named in `keep`.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, buffers, hashed, mix, slices, text_of

BLANK = 0x2581
#: Units of up to MANY code points come in batches of one length; a batch has CELLS end positions at most.
MANY, CELLS = 48, 1 << 18
_COMMON = 1024


def codes_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)


class Pieces:
    """The vocabulary as arrays: made once on the driver, then shared; its size is that of the model."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        """kinds: "piece", "byte" or "other" for each id."""
        self.text = pieces
        self.bytes_at = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == "byte"}
        own = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == "piece"}
        blank = chr(BLANK)
        self.blanks = {len(p): i for p, i in own.items() if set(p) == {blank}}
        # Runs of blanks are joined after everything else.
        self.rank = {p: -scores[i] for p, i in own.items() if len(p) > 1 and set(p) != {blank}}
        self.id = {p: i for p, i in own.items() if len(p) == 1 or p in self.rank}
        n = len(pieces)
        self.order = np.full(n, -1.0)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        alive = []
        for p, i in self.id.items():
            if len(p) == 1:
                alive.append(i)
                continue
            parts = self.merge(p)
            if parts[0] == 1 and len(p) > 1:
                a, b = parts[1]
                self.left[i], self.right[i], self.order[i] = self.id[a], self.id[b], self.rank[p]
                alive.append(i)
        self.most = max(len(pieces[i]) for i in alive)
        keys = self._keys([pieces[i] for i in alive])
        place = np.argsort(keys)
        self.keys, self.ids = keys[place], np.array(alive, np.int64)[place]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one key")
        self.codes = np.zeros((n, self.most), np.uint32)
        for i in alive:
            self.codes[i, : len(pieces[i])] = [ord(c) for c in pieces[i]]
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.keys >> np.uint64(42)).astype(np.int64)] = True
        joined = np.flatnonzero(self.left >= 0)
        pair = self.left[joined] << 20 | self.right[joined]
        place = np.argsort(pair)
        self.pairs, self.pair_order = pair[place], self.order[joined[place]]
        # Neighbouring code points that some piece holds; code points are renumbered by how many pieces have them.
        use: dict[str, int] = {}
        for i in alive:
            for c in pieces[i]:
                use[c] = use.get(c, 0) + 1
        number = {c: k + 1 for k, c in enumerate(sorted(use, key=lambda c: (-use[c], c)))}
        self.number = np.zeros(0x110000, np.uint16)
        for c, k in number.items():
            self.number[ord(c)] = k
        self.single = np.full(len(number) + 1, -1, np.int64)
        for c, k in number.items():
            self.single[k] = self.id.get(c, -1)
        both = np.unique(np.array([number[x] << 16 | number[y] for i in alive for x, y in zip(pieces[i], pieces[i][1:])] or [0], np.int64))
        self.near = np.zeros((_COMMON, _COMMON), bool)
        x, y = both >> 16, both & 0xFFFF
        low = (x < _COMMON) & (y < _COMMON)
        self.near[x[low], y[low]] = True
        self.far = both[~low]
        # For decoding.
        body = [bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(blank, " ").encode() if k == "piece" else b"" for p, k in zip(pieces, kinds)]
        self.body = np.frombuffer(b"".join(body), np.uint8)
        self.body_at = np.r_[0, np.cumsum([len(b) for b in body])]
        self.spaced = np.array([p.startswith(blank) for p in pieces])
        self.memo_key, self.memo = None, None

    @staticmethod
    def _keys(texts: list[str]) -> np.ndarray:
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        end = np.cumsum([len(t) for t in texts])
        return Rolling(codes).of(end - np.array([len(t) for t in texts]), end)

    def merge(self, unit: str, rank: dict[str, float] | None = None) -> tuple[int, list[str]]:
        """(number of parts after all merges, parts before the last one if that left a single part, else the parts)."""
        rank = self.rank if rank is None else rank
        part, nxt, prv = list(unit), [*range(1, len(unit)), -1], [*range(-1, len(unit) - 1)]
        heap = [(r, i, part[i] + part[i + 1]) for i in range(len(unit) - 1) if (r := rank.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        count, last = len(unit), list(unit)
        while heap:
            _, i, t = heapq.heappop(heap)
            j = nxt[i] if part[i] is not None else -1
            if j < 0 or part[i] + part[j] != t:
                continue
            if count == 2:
                return 1, [part[i], part[j]]
            part[i], part[j] = t, None
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            count -= 1
            for a, b in ((prv[i], i), (i, nxt[i])):
                if a >= 0 and b >= 0 and (r := rank.get(part[a] + part[b])) is not None:
                    heapq.heappush(heap, (r, a, part[a] + part[b]))
        last = [p for p in part if p is not None]
        return len(last), last

    def blank_run(self, n: int) -> list[int]:
        """Ids of n blanks in a row: all their joins rank alike, so the leftmost comes first."""
        count, parts = self.merge(chr(BLANK) * n, {chr(BLANK) * k: 0.0 for k in self.blanks if k > 1})
        return [self.blanks[n]] if count == 1 else [self.blanks[len(p)] for p in parts]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these keys, -1 for none."""
        out = np.full(len(keys), -1, np.int64)
        maybe = np.flatnonzero(self.sieve[(keys >> np.uint64(42)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == keys[maybe]
        out[maybe[hit]] = self.ids[at[hit]]
        return out

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """True where the merges of a and b, side by side, never join across their border."""
        if self.memo_key is None:
            self.memo_key, self.memo = np.full(1 << 21, -1, np.int64), np.zeros(1 << 21, bool)
        pair = a << 20 | b
        slot = (mix(pair.astype(np.uint64)) >> np.uint64(43)).astype(np.int64)
        known = self.memo_key[slot] == pair
        out = self.memo[slot]
        todo = np.flatnonzero(~known)
        if len(todo):
            fresh, back = np.unique(pair[todo], return_inverse=True)
            solved = self._undo(fresh >> 20, fresh & 0xFFFFF)
            out[todo] = solved[back]
            self.memo_key[slot[todo]], self.memo[slot[todo]] = pair[todo], out[todo]
            # Two pairs of one slot may have been written in this call: keep the pair and its answer together.
            self.memo[slot[todo]] = solved[np.searchsorted(fresh, self.memo_key[slot[todo]])]
        return out

    def _undo(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Take the latest merge apart on either side of the border; none may have come after a join across it was due."""
        a, b = a.copy(), b.copy()
        out, live, limit = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), np.inf)
        over = np.zeros(len(a), bool)  # the limit itself counts as due
        while len(live):
            x, y = a[live], b[live]
            at = np.minimum(np.searchsorted(self.pairs, x << 20 | y), len(self.pairs) - 1)
            joins = self.pairs[at] == (x << 20 | y)
            due = joins & ((self.pair_order[at] < limit[live]) | over[live] & (self.pair_order[at] == limit[live]))
            out[live[due]] = False
            ox, oy = self.order[x], self.order[y]
            going = ~due & ((ox >= 0) | (oy >= 0))
            take = ox > oy  # the left one was made later
            left, right = live[going & take], live[going & ~take]
            limit[left], over[left] = self.order[a[left]], False
            a[left] = self.right[a[left]]
            limit[right], over[right] = self.order[b[right]], True
            b[right] = self.left[b[right]]
            live = live[going]
        return out

    def matches(self, codes: np.ndarray, spans: Rolling, start: np.ndarray, size: int) -> np.ndarray:
        """Ids of the pieces that are the `size` code points from each start, -1 for none."""
        ids = self.find(spans.of(start, start + size))
        hit = np.flatnonzero(ids >= 0)
        same = (codes[start[hit][:, None] + np.arange(size)] == self.codes[ids[hit], :size]).all(1)
        if size < self.most:
            same &= self.codes[ids[hit], size] == 0
        ids[hit[~same]] = -1
        return ids

    def _advance(self, codes: np.ndarray, spans: Rolling, start: np.ndarray, length: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(units, ids) of the pieces of each unit, from the last to the first. Lengths fall."""
        m, n, wide = len(start), int(length[0]), min(self.most, int(length[0]))
        found = np.full((n + 1, wide, m), -1, np.int32)  # by end, size (longest first) and unit
        for size in range(1, wide + 1):
            end = np.repeat(np.arange(size, n + 1), m).reshape(-1, m)
            here = end <= length
            found[size:, wide - size][here] = self.matches(codes, spans, (start + end - size)[here], size)
        last, came, score = np.full((n + 1, m), -1, np.int64), np.zeros((n + 1, m), np.int32), np.zeros((n + 1, m), np.int8)
        score[0] = 1
        for e in range(1, n + 1):
            row, unit = np.nonzero(found[e] >= 0)
            ids, back = found[e, row, unit].astype(np.int64), e - (wide - row)
            inner = np.flatnonzero(back > 0)
            path = score[back, unit]
            inner = inner[path[inner] > 0]
            path[inner] *= self.stable(last[back[inner], unit[inner]], ids[inner])
            np.maximum.at(score[e], unit, path)
            best = np.flatnonzero((path == score[e, unit]) & (path > 0))
            last[e, unit[best]], came[e, unit[best]] = ids[best], back[best]
        out, place, active = [], length.copy(), np.arange(m)
        while len(active):
            out.append((active, last[place[active], active]))
            place[active] = came[place[active], active]
            active = active[place[active] > 0]
        return out

    def encode_units(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units end to end, and their bounds. An id below 0 stands for the code point -1 - id."""
        length = end - start
        spans = Rolling(codes)
        back: list[tuple[np.ndarray, np.ndarray]] = []  # (unit, ids from the last to the first)
        one = np.flatnonzero(length == 1)
        ids = self.single[self.number[codes[start[one]]]]
        back.append((one, np.where(ids < 0, -1 - codes[start[one]].astype(np.int64), ids)))
        groups = [np.flatnonzero(length == n) for n in range(2, MANY + 1)] + [np.flatnonzero(length > MANY)]
        for group in groups:
            group = group[np.argsort(-length[group], kind="stable")]
            while len(group):
                most = max(1, CELLS // int(length[group[0]]))
                now, group = group[:most], group[most:]
                back += [(now[u], i) for u, i in self._advance(codes, spans, start[now], length[now])]
        unit = np.concatenate([b[0] for b in back])
        ids = np.concatenate([b[1] for b in back])
        # Of one unit, later entries come first in the text.
        order = np.lexsort((-np.arange(len(unit)), unit))
        return ids[order], np.r_[0, np.cumsum(np.bincount(unit, minlength=len(start)))]

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every row end to end, and the bounds of rows."""
        n = len(bounds) - 1
        codes = codes_of(data.tobytes())
        points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][bounds]
        full = np.diff(points) > 0
        lead = np.cumsum(np.r_[0, full])
        own = np.full(len(codes) + int(full.sum()), BLANK, np.uint32)
        own[np.arange(len(codes)) + np.repeat(lead[1:], np.diff(points))] = np.where(codes == 32, np.uint32(BLANK), codes)
        edges = points + lead
        if not len(own):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        num = self.number[own].astype(np.int64)
        x, y = num[:-1], num[1:]
        low = (x < _COMMON) & (y < _COMMON)
        held = np.zeros(len(x), bool)
        held[low] = self.near[x[low], y[low]]
        high = np.flatnonzero(~low)
        if len(high) and len(self.far):
            pair = x[high] << 16 | y[high]
            held[high] = self.far[np.minimum(np.searchsorted(self.far, pair), len(self.far) - 1)] == pair
        held &= ~((own[:-1] == BLANK) & (own[1:] == BLANK))
        begin = np.r_[True, ~held]
        begin[edges[:-1][full]] = True
        start = np.flatnonzero(begin)
        end = np.r_[start[1:], len(own)]
        key = hashed(own.view(np.uint8), 4 * start, 4 * end)
        _, at, which = np.unique(key, return_index=True, return_inverse=True)
        ids, bound = self.encode_units(own, start[at], end[at])
        count = np.diff(bound)[which]
        flat = ids[np.repeat(bound[:-1][which] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())]
        edges = np.r_[0, np.cumsum(count)][np.searchsorted(start, edges)]
        return self._finish(flat, edges)

    def _finish(self, ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Join runs of blanks, and spell what has no piece in bytes."""
        rows = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        blank = ids == self.blanks.get(1, -2)
        if len(self.blanks) > 1 and (blank[1:] & blank[:-1]).any():
            start = np.flatnonzero(blank & np.r_[True, ~(blank[:-1] & (rows[1:] == rows[:-1]))])
            length = np.bincount(np.searchsorted(start, np.flatnonzero(blank), "right") - 1, minlength=len(start))
            keep, ids = np.ones(len(ids), bool), ids.copy()
            for n in np.unique(length[length > 1]).tolist():
                parts = self.blank_run(n)
                at = start[length == n][:, None] + np.arange(n)
                ids[at[:, : len(parts)]] = parts
                keep[at[:, len(parts) :]] = False
            ids, rows = ids[keep], rows[keep]
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            spelled = [chr(-1 - c).encode("utf-8", "replace") for c in ids[odd].tolist()]
            size = np.ones(len(ids), np.int64)
            size[odd] = [len(b) for b in spelled]
            at = np.cumsum(size) - size
            out = np.repeat(ids, size)
            flat = np.repeat(at[odd] - np.r_[0, np.cumsum(size[odd])[:-1]], size[odd]) + np.arange(size[odd].sum())
            table = np.array([self.bytes_at.get(b, 0) for b in range(256)])
            out[flat] = table[np.frombuffer(b"".join(spelled), np.uint8)]
            ids, rows = out, np.repeat(rows, size)
        return ids.astype(np.int32), np.r_[0, np.cumsum(np.bincount(rows, minlength=len(edges) - 1))]

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> list[str]:
        """The text of every row; broken byte sequences become U+FFFD. Ids outside the vocabulary raise IndexError."""
        n = np.diff(self.body_at)[ids]
        skip = np.zeros(len(ids), np.int64)
        some = np.flatnonzero(np.diff(edges) > 0)
        skip[edges[some]] = self.spaced[ids[edges[some]]]
        start, n = self.body_at[ids] + skip, n - skip
        at = np.r_[0, np.cumsum(n)]
        flat = self.body[np.repeat(start - at[:-1], n) + np.arange(at[-1])].tobytes()
        cuts = at[edges].tolist()
        return [flat[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]


#: Fields of a SentencePiece model file that are read here, by number: trainer (2) with its model type (3; 2 is BPE) and
#: byte fallback (35), normaliser (3) with its name (1) and dummy prefix (3).
TRAINER, NORMALISER, MODEL_TYPE, BPE, BYTE_FALLBACK, NAME, DUMMY_PREFIX = 2, 3, 3, 2, 35, 1, 3


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


def load(path: str) -> Pieces:
    """The vocabulary of a SentencePiece model file. Raises ValueError if the model is not of type BPE or prepares texts otherwise than supported here."""
    import sentencepiece

    with open(path, "rb") as f:
        parts = {n: v for n, v in _fields(f.read()) if n in (TRAINER, NORMALISER)}
    trainer, normaliser = (dict(_fields(parts.get(n, b""))) for n in (TRAINER, NORMALISER))
    if trainer.get(MODEL_TYPE, 1) != BPE:
        raise ValueError("the model is not of type BPE")
    if normaliser.get(NAME, b"identity") not in (b"identity", b"") or not normaliser.get(DUMMY_PREFIX, 1) or not trainer.get(BYTE_FALLBACK, 0):
        raise ValueError("only identity normalisation with dummy prefix and byte fallback is supported")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = ["byte" if m.is_byte(i) else "other" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "piece" for i in range(m.get_piece_size())]
    return Pieces([m.id_to_piece(i) for i in range(len(kinds))], [m.get_score(i) for i in range(len(kinds))], kinds)


def encode(docs: DataFrame, pieces: Pieces, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and `ids`, an array of int."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    own = docs.select(*keep)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in own.dtypes), "ids array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_piece_text"):
                ids, edges = shared.value.encode(*buffers(batch.column("_piece_text")))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids))], names=[*keep, "ids"])

    return docs.select(*keep, text_of(text).cast("binary").alias("_piece_text")).mapInArrow(run, schema)


def decode(coded: DataFrame, pieces: Pieces, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and `text`. Null ids give an empty text."""
    shared = coded.sparkSession.sparkContext.broadcast(pieces)
    own = coded.select(*keep)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in own.dtypes), "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 1000):
                batch = whole.slice(s, 1000)
                lists = batch.column(batch.num_columns - 1)
                n = np.r_[0, np.cumsum(pa.compute.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))]
                texts = shared.value.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), n)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    return coded.select(*keep, F.col(ids).alias("_ids")).mapInArrow(run, schema)
