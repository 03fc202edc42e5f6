"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy.

Every run of WIDTH words of a text is a window (a shorter text is one); each window gets a logit, and the greatest decides. Windows share
the states of their words: the state of a word reads the STRIDE words up to it, and those before them that share its lead-in, forwards
and likewise backwards, so all windows together cost as much as every STRIDEth alone; each pools its own words by attention. The network learns from labelled texts alone: first every window bears its text's label, then only the windows of a toxic text
that score highest count as toxic (and the highest of clean texts as clean). Scores are calibrated on texts held back from
the fit. The fit uses a bounded sample (Fit.most_toxic, Fit.most_clean, Fit.longest) and windows at every STRIDEth word of it, at most
Fit.windows_of_text of a text and Fit.windows draws of a kind in an epoch; scoring reads every window of every whole text.

Defined cases: null and empty texts are one empty window and get a score; unlabelled rows are scored alike; null labels and labels of
unknown texts are ignored; without any label of either kind every score is 0.5; repeated rows score alike; an empty
table gives no rows; columns with other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, hashed, portions, slices, text_of, words

WIDTH, STRIDE = 32, 16
WORD_BITS, GRAM_BITS = 14, 14
DIM, HID, ATT = 8, 8, 8
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[i for i in range(128) if not chr(i).isalnum()]] = 32


@dataclass(frozen=True)
class Fit:
    """most_toxic, most_clean: greatest numbers of labelled texts the fit sees; longest: bytes of the longest of them, so that the driver holds a bounded amount."""

    most_toxic: int = 2000
    most_clean: int = 3000
    longest: int = 16384
    #: Toxic texts held back that the calibration needs.
    least_held: int = 30
    windows_of_text: int = 24
    windows: int = 5000
    #: Entries of the input tables that fewer texts use stay zero, so that rare words are not learnt by heart.
    least_texts: int = 4
    rounds: int = 3
    epochs: int = 2
    batch: int = 256
    rate: float = 0.02
    #: The input tables move by this share of the rate, as each entry is seen by few texts.
    table_rate: float = 0.03
    seed: int = 7


class Tokens:
    """Words of texts as table rows: hashed word, and hashed 4-byte grams with word ends."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        n = len(bounds) - 1
        # Two spaces before each text, so that no gram reaches into the next one.
        lead = np.arange(len(data)) + 2 + np.repeat(2 * np.arange(n), np.diff(bounds))
        own = np.full(len(data) + 2 * n + 5, 32, np.uint8)
        own[lead] = _FOLD[data]
        edges = bounds + 2 * np.arange(n + 1)
        starts, ends, self.first = words(own, np.r_[edges[:-1], len(own)]) if n else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64))
        self.word = (hashed(own, starts, ends) >> np.uint64(64 - WORD_BITS)).astype(np.int32)
        wide = own.astype(np.uint32)
        grams = np.zeros(len(own), np.uint32)
        grams[:-3] = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
        grams = ((grams * np.uint32(2654435761)) ^ (grams >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(32 - GRAM_BITS)
        counts = np.maximum(ends - starts - 1, 1)
        self.at = np.r_[0, np.cumsum(counts)]
        self.gram = grams[np.repeat(starts - 1 - self.at[:-1], counts) + np.arange(self.at[-1])].astype(np.int32)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, index of the first word, number of words) of every window; a row has at least one."""
        n = np.diff(self.first)
        many = np.maximum(1, -(-(n - WIDTH) // STRIDE) + 1)
        row = np.repeat(np.arange(len(n)), many)
        k = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(many)[:-1]], many)
        start = self.first[:-1][row] + k * STRIDE
        return row, start, np.clip(self.first[1:][row] - start, 0, WIDTH)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        make = lambda *s, k=1.0: (r.standard_normal(s) * k).astype(np.float32)
        self.p = {"word": make(1 << WORD_BITS, DIM, k=0.05), "gram": make(1 << GRAM_BITS, DIM, k=0.05), "Wa": make(2 * HID, ATT, k=0.4), "ba": np.zeros(ATT, np.float32), "va": make(ATT, k=0.4), "wo": make(2 * HID, k=0.4), "bo": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": make(2 * DIM, 3 * HID, k=0.35), f"U{d}": make(HID, 3 * HID, k=0.35), f"b{d}": np.zeros(3 * HID, np.float32)}
        #: Logits and the scores they stand for, both rising; scores between are interpolated.
        self.knots, self.values = np.zeros(1), np.full(1, 0.5)

    def inputs(self, t: Tokens) -> np.ndarray:
        chars = np.add.reduceat(self.p["gram"][t.gram], t.at[:-1], axis=0) * np.float32(0.5) if len(t.word) else np.zeros((0, DIM), np.float32)
        return np.concatenate([self.p["word"][t.word], chars], axis=1)

    def _way(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States (position, window, HID); x: projected inputs (position, window, 3 HID)."""
        h = np.zeros((x.shape[1], HID), np.float32)
        out = np.empty((len(x), x.shape[1], HID), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            u = h @ self.p[f"U{d}"]
            zr = _sigmoid(x[t, :, : 2 * HID] + u[:, : 2 * HID])
            z, r, un = zr[:, :HID], zr[:, HID:], u[:, 2 * HID :]
            n = np.tanh(x[t, :, 2 * HID :] + r * un)
            m = mask[t][:, None]
            new = h + m * (1 - z) * (n - h)
            if keep is not None:
                keep.append((t, h, z, r, un, n, m))
            h = out[t] = new
        return out

    def forward(self, x: np.ndarray, start: np.ndarray, n: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows over the word inputs x."""
        at = start + np.arange(WIDTH)[:, None]
        mask = (np.arange(WIDTH)[:, None] < n).astype(np.float32)
        at = np.minimum(at, max(len(x) - 1, 0))
        both = []
        for d in "fb":
            px = x @ self.p[f"W{d}"] + self.p[f"b{d}"] if len(x) else np.zeros((1, 3 * HID), np.float32)
            steps: list | None = [] if keep is not None else None
            both.append(self._way(px[at], mask, d, steps))
            if keep is not None:
                keep[d] = steps
        h = np.concatenate(both, axis=2)
        a = np.tanh(h @ self.p["Wa"] + self.p["ba"])
        e = a @ self.p["va"] + (mask - 1) * 30
        w = np.exp(e - e.max(0))
        w *= mask
        w /= w.sum(0) + 1e-9
        pooled = (w[:, :, None] * h).sum(0)
        if keep is not None:
            keep |= {"at": at, "mask": mask, "h": h, "a": a, "w": w, "pooled": pooled}
        return pooled @ self.p["wo"] + self.p["bo"][0]

    def gradient(self, x: np.ndarray, start: np.ndarray, n: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the weighted log loss: for the parameters, and for x."""
        k: dict = {}
        logit = self.forward(x, start, n, k)
        g = {}
        dl = ((_sigmoid(logit) - label) * weight / weight.sum()).astype(np.float32)
        g["wo"], g["bo"] = k["pooled"].T @ dl, np.array([dl.sum()], np.float32)
        dp = dl[:, None] * self.p["wo"]
        dh = k["w"][:, :, None] * dp
        dw = (k["h"] * dp).sum(2)
        de = k["w"] * (dw - (k["w"] * dw).sum(0))
        g["va"] = np.tensordot(de, k["a"], ((0, 1), (0, 1)))
        da = de[:, :, None] * self.p["va"] * (1 - k["a"] ** 2)
        g["Wa"], g["ba"] = np.tensordot(k["h"], da, ((0, 1), (0, 1))), da.sum((0, 1))
        dh += da @ self.p["Wa"].T
        dx = np.zeros_like(x)
        for d, part in (("f", dh[:, :, :HID]), ("b", dh[:, :, HID:])):
            dpx = np.zeros((WIDTH, len(dl), 3 * HID), np.float32)
            U, dU, back = self.p[f"U{d}"], np.zeros((HID, 3 * HID), np.float32), np.zeros((len(dl), HID), np.float32)
            for t, h, z, r, un, nn, m in reversed(k[d]):
                top = part[t] + back
                dn, dz = top * m * (1 - z) * (1 - nn**2), -top * m * (nn - h) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                du = np.concatenate([dz, dr, dn * r], 1)
                dpx[t] = np.concatenate([dz, dr, dn], 1)
                dU += h.T @ du
                back = top * (1 - m * (1 - z)) + du @ U.T
            flat = dpx.reshape(-1, 3 * HID)
            xs = x[k["at"]].reshape(-1, 2 * DIM)
            g[f"U{d}"], g[f"W{d}"], g[f"b{d}"] = dU, xs.T @ flat, flat.sum(0)
            np.add.at(dx, k["at"].ravel(), flat @ self.p[f"W{d}"].T)
        return g, dx

    def states(self, t: Tokens) -> np.ndarray:
        """Both states of every word: each way reads from the start of the STRIDE words before the word's own STRIDE, or after them."""
        x, n = self.inputs(t), np.diff(t.first)
        many = -(-n // STRIDE)
        row = np.repeat(np.arange(len(n)), many)
        own = (np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(many)[:-1]], many)) * STRIDE
        out = np.zeros((len(x), 2 * HID), np.float32)
        given = {d: x @ self.p[f"W{d}"] + self.p[f"b{d}"] for d in "fb"}
        for s in range(0, len(row), 8192):
            r, k = row[s : s + 8192], own[s : s + 8192]
            for d, lead, held, cols in (("f", STRIDE, slice(STRIDE, 2 * STRIDE), slice(0, HID)), ("b", 0, slice(0, STRIDE), slice(HID, 2 * HID))):
                place = k - lead + np.arange(2 * STRIDE)[:, None]
                inside = (place >= 0) & (place < n[r])
                at = np.where(inside, t.first[:-1][r] + place, 0)
                h = self._way(given[d][at], inside.astype(np.float32), d, None)
                out[at[held][inside[held]], cols] = h[held][inside[held]]
        return out

    def text_logits(self, t: Tokens) -> np.ndarray:
        """The greatest logit of each row's windows, one starting at every word."""
        n = np.diff(t.first)
        if not len(n):
            return np.zeros(0)
        h = self.states(t)
        e = np.exp((np.tanh(h @ self.p["Wa"] + self.p["ba"]) @ self.p["va"]).astype(np.float64))
        # Rows lie WIDTH zeros apart, so that sums over WIDTH places never mix them.
        edges = np.r_[0, np.cumsum(n + WIDTH)]
        place = np.arange(len(h)) + np.repeat(np.arange(len(n)) * WIDTH, n)
        sums = np.zeros((2, edges[-1] + WIDTH))
        sums[0, place], sums[1, place] = e, e * (h @ self.p["wo"])
        step = 1
        while step < WIDTH:  # WIDTH is a power of two
            sums[:, :-step] += sums[:, step:].copy()
            step *= 2
        logit = sums[1, : edges[-1]] / (sums[0, : edges[-1]] + 1e-9) + self.p["bo"][0]
        late = np.arange(edges[-1]) - np.repeat(edges[:-1], n + WIDTH) > np.repeat(np.maximum(n - WIDTH, 0), n + WIDTH)
        logit[late] = -np.inf
        return np.maximum.reduceat(logit, edges[:-1])

    def scores(self, t: Tokens) -> np.ndarray:
        z = self.text_logits(t).astype(np.float64)
        # A hundredth of the plain sigmoid keeps the order where the calibration is flat.
        return 0.99 * np.interp(z, self.knots, self.values) + 0.01 * _sigmoid(z - self.knots.mean()) if len(self.knots) > 1 else np.full(len(z), float(self.values[0]))


def _tables(bodies: list[bytes]) -> Tokens:
    data = np.frombuffer(b"".join(bodies), np.uint8)
    return Tokens(data, np.r_[0, np.cumsum([len(b) for b in bodies])].astype(np.int64))


class Sample:
    """The tokens of some texts in portions, and the same end to end."""

    def __init__(self, bodies: list[bytes]):
        self.parts = [_tables(bodies[at]) for at in portions([len(b) for b in bodies], 1 << 19)]
        self.word, self.gram = (np.concatenate([getattr(t, x) for t in self.parts]) for x in ("word", "gram"))
        self.counts = np.concatenate([np.diff(t.at) for t in self.parts])
        self.at = np.r_[0, np.cumsum(self.counts)]
        windows, rows, before = [], 0, 0
        for t in self.parts:
            row, start, n = t.windows()
            windows.append((row + rows, start + before, n))
            rows, before = rows + len(t.first) - 1, before + len(t.word)
        self.row, self.start, self.n = (np.concatenate(x) for x in zip(*windows))

    def logits(self, net: Network, use: np.ndarray) -> np.ndarray:
        """Of the windows in `use`, which rises."""
        out, before, place = np.zeros(len(use)), 0, 0
        for t in self.parts:
            end = place + np.searchsorted(self.start[use[place:]], before + max(len(t.word), 1))
            end = max(end, place)
            at = use[place:end]
            out[place:end] = net.forward(net.inputs(t), self.start[at] - before, self.n[at])
            place, before = end, before + len(t.word)
        return out

    def text_logits(self, net: Network) -> np.ndarray:
        return np.concatenate([net.text_logits(t) for t in self.parts])


def telling(sample: Sample, labels: np.ndarray, name: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A start for the first input: how far each entry's share of toxic texts and of clean ones differ, in standard errors above three. And the texts with each entry."""
    a, b, rows = np.zeros(size), np.zeros(size), 0
    for t in sample.parts:
        ids = t.word if name == "word" else t.gram
        word = np.arange(len(t.word)) if name == "word" else np.repeat(np.arange(len(t.word)), np.diff(t.at))
        pair = np.unique((np.searchsorted(t.first, word, "right") - 1 + rows).astype(np.int64) * size + ids)
        toxic = labels[pair // size] == 1
        a += np.bincount(pair[toxic] % size, minlength=size)
        b += np.bincount(pair[~toxic] % size, minlength=size)
        rows += len(t.first) - 1
    na, nb = max(1, (labels == 1).sum()), max(1, (labels == 0).sum())
    p = (a + b + 1) / (na + nb + 2)
    z = (a / na - b / nb) / np.sqrt(p * (1 - p) * (1 / na + 1 / nb))
    return (np.sign(z) * np.clip(np.abs(z) - 3, 0, 8) / 4).astype(np.float32), a + b


def fit(bodies: list[bytes], labels: np.ndarray, how: Fit = Fit()) -> Network:
    """The network for these labelled texts."""
    net, r = Network(how.seed), np.random.default_rng(how.seed)
    if not len(labels) or labels.min() == labels.max():
        return net
    held = r.permutation(len(labels)) % 5 == 0
    if len(set(labels[~held])) < 2 or len(set(labels[held])) < 2:
        held[:] = False
    train = np.flatnonzero(~held)
    tokens = Sample([bodies[i] for i in train])
    own = labels[train]
    known = {}
    for name in ("word", "gram"):
        lean, texts = telling(tokens, own, name, len(net.p[name]))
        net.p[name][:, 0] += lean
        known[name] = (texts >= how.least_texts)[:, None].astype(np.float32)
        net.p[name] *= known[name]
    row, start, n = tokens.row, tokens.start, tokens.n
    # At most windows_of_text of each text, spread evenly.
    count = np.bincount(row)
    place = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
    use = (place * how.windows_of_text) // np.maximum(count[row], how.windows_of_text) != ((place - 1) * how.windows_of_text) // np.maximum(count[row], how.windows_of_text)
    use = np.flatnonzero(use)
    row, start, n = row[use], start[use], n[use]
    mean, var = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    step = 0
    logit = r.standard_normal(len(row))
    for turn in range(how.rounds):
        # Of clean texts, all windows; of toxic ones, all at first, then the highest and those near it.
        top = np.full(len(own), -np.inf)
        np.maximum.at(top, row, logit)
        chosen = np.flatnonzero((own[row] == 0) | (turn == 0) | (logit >= top[row] - 1e-6) | (logit > 1.0))
        good, bad = chosen[own[row[chosen]] == 0], chosen[own[row[chosen]] == 1]
        each = min(max(4 * len(bad), 1500), how.windows)
        for _ in range(how.epochs):
            hard = good[np.argsort(-logit[good])[: each // 2]] if turn else good[:0]
            pick = np.r_[r.choice(bad, each), r.choice(good, each), hard]
            for at in np.array_split(r.permutation(pick), max(1, len(pick) // how.batch)):
                step += 1
                rate = how.rate * min(1.0, step / 20)
                lo, hi = start[at], start[at] + n[at]
                # Only the words of this batch.
                idx = np.minimum(lo[:, None] + np.arange(WIDTH), len(tokens.word) - 1)
                flat = idx.ravel()
                counts = tokens.counts[flat]
                grams = tokens.gram[np.repeat(tokens.at[:-1][flat] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())]
                edge = np.r_[0, np.cumsum(counts)[:-1]]
                seen = (r.random(len(flat)) > 0.3).astype(np.float32)[:, None]
                x = np.concatenate([net.p["word"][tokens.word[flat]] * seen, np.add.reduceat(net.p["gram"][grams], edge, axis=0) * np.float32(0.5)], 1)
                y = own[row[at]].astype(np.float32)
                g, dx = net.gradient(x, np.arange(len(at)) * WIDTH, hi - lo, y, np.ones(len(at), np.float32))
                for name, ids, v in (("word", tokens.word[flat], dx[:, :DIM] * seen), ("gram", grams, np.repeat(dx[:, DIM:] * np.float32(0.5), counts, axis=0))):
                    g[name] = np.stack([np.bincount(ids, v[:, j], minlength=len(net.p[name])) for j in range(DIM)], 1).astype(np.float32)
                for name, v in g.items():
                    if name in ("word", "gram"):
                        v = (v + 2e-6 * net.p[name]) * known[name]
                    mean[name] += 0.1 * (v - mean[name])
                    var[name] += 0.01 * (v * v - var[name])
                    net.p[name] -= rate * (how.table_rate if name in ("word", "gram") else 1.0) * (mean[name] / (1 - 0.9**step)) / (np.sqrt(var[name] / (1 - 0.99**step)) + 1e-6)
        logit = tokens.logits(net, use)
    # Calibrated on the texts held back, or on all of the sample where these hold too few toxic ones to tell.
    at = np.flatnonzero(held) if labels[held].sum() >= how.least_held else np.arange(len(labels))
    z = Sample([bodies[i] for i in at]).text_logits(net).astype(np.float64)
    net.knots, net.values = rising_share(z, labels[at])
    return net


def rising_share(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(middles of blocks of z, smoothed shares of y = 1 in them): neighbouring blocks are joined until the shares rise (isotonic regression)."""
    order = np.argsort(z, kind="stable")
    blocks: list[list[float]] = []  # (positives, rows, sum of z)
    for x, hit in zip(z[order].tolist(), y[order].tolist()):
        blocks.append([hit, 1, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    knots = np.array([b[2] / b[1] for b in blocks])
    values = np.array([(b[0] + 0.5) / (b[1] + 1) for b in blocks])
    return knots, np.maximum.accumulate(values)


def train(docs: DataFrame, labels: DataFrame, how: Fit = Fit(), doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Network:
    """Fit on labelled rows whose crc32(doc_id as text) is not 1 modulo 3; a bounded number of them reaches the driver."""
    marks = labels.select(F.col(doc_id).cast("long").alias("_id"), F.col(label).cast("int").alias("_y")).where("_y in (0, 1) and crc32(cast(_id as string)) % 3 <> 1").groupBy("_id").agg(F.max("_y").alias("_y"))
    rank = F.xxhash64("_id")
    # The bound is applied to ids that exist, before texts are read.
    known = marks.join(docs.where(F.octet_length(text_of(text)) <= how.longest).select(F.col(doc_id).cast("long").alias("_id")), "_id", "left_semi")
    few = known.where("_y = 1").orderBy(rank, "_id").limit(how.most_toxic).unionByName(known.where("_y = 0").orderBy(rank, "_id").limit(how.most_clean))
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), text_of(text).cast("binary").alias("_text")).where(F.octet_length("_text") <= how.longest).join(few, "_id").orderBy(rank, "_id").select("_text", "_y").toLocalIterator()
    pairs = [(bytes(x[0]), x[1]) for x in rows]
    return fit([p[0] for p in pairs], np.array([p[1] for p in pairs], np.int64), how)


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, how: Fit = Fit(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted): one row for each row of docs."""
    net = train(docs, labels, how, doc_id, text)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # fixed size: two tables of 2**14 rows and small matrices

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in slices(whole, "_text", 1 << 19):
                s = model.scores(Tokens(*buffers(batch.column("_text"))))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    own = F.col(doc_id).cast("long")
    held = F.coalesce(F.crc32(own.cast("string")) % 3 == 1, F.lit(False))
    return docs.select(own.alias("doc_id"), held.alias("held_out"), text_of(text).cast("binary").alias("_text")).mapInArrow(score, SCHEMA)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, how: Fit = Fit(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text scores below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, how, doc_id, text))
    place = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in slices(whole, place, 1 << 19):
                yield batch.filter(pa.array(model.scores(Tokens(*buffers(batch.column(place)))) < threshold))

    return docs.mapInArrow(keep, docs.schema)
