"""Quality classifier from weak labels: overlapping heuristic labellers vote, expectation-maximisation over the
histogram of vote patterns estimates how each votes on either class, and the posteriors train a hashed linear scorer.

No labelled row is used. The histogram covers all rows and has at most 3**10 entries; the scorer is fitted on a bounded sample
(Fit.most_texts, Fit.longest) and scores every whole text. Defined cases: null and empty texts have no words, score 0 and are not kept; repeated rows score alike;
where all texts vote alike the scorer follows the prior; an empty table gives no rows; columns with other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, cut, hashed, portions, slices, sums, text_of, words
from .quality_rules import text_counts

#: What each labeller measures, with limits (bad, good): "rising" labellers call high values bad.
LABELLERS = (
    ("word like the one before", "rising", 0.15, 0.03),
    ("symbols for each word", "rising", 0.25, 0.03),
    ("words without letter or digit", "rising", 0.15, 0.02),
    ("words in repeated 8-word windows", "rising", 0.30, 0.05),
    ("short words", "falling", 0.10, 0.22),
    ("repeated lines", "rising", 0.30, 0.02),
    ("code points for each word, from 5.5", "rising", 4.5, 3.0),
    ("words with inner symbols", "rising", 0.15, 0.02),
    ("words in capitals", "rising", 0.25, 0.03),
    ("words that end in a doubled mark", "rising", 0.20, 0.02),
)
WORD_BITS, SHAPES = 12, 256
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>{}[]=~^_\\@/+", np.uint8))
_ALNUM = np.array([chr(i).isalnum() if i < 128 else True for i in range(256)])


@dataclass(frozen=True)
class Fit:
    """most_texts: greatest number of texts the scorer learns from; longest: bytes of the longest of them, so that the driver holds a bounded amount."""

    most_texts: int = 6000
    longest: int = 16384
    epochs: int = 12
    batch: int = 200
    rate: float = 0.05
    em_rounds: int = 200
    seed: int = 11


class Features:
    """Measures and votes of rows, and for each word its hashed bucket and its shape."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        c = text_counts(data, bounds)
        starts, ends, self.first = words(data, bounds)
        word = hashed(data, starts, ends)
        n = self.n = np.diff(self.first)
        rows = np.repeat(np.arange(len(n)), n)
        total = lambda flags: np.r_[0, np.cumsum(flags)]
        symbols, alnum = total(_SYMBOL[data]), total(_ALNUM[data])
        same = np.zeros(len(word), bool)
        same[1:] = (word[1:] == word[:-1]) & (rows[1:] == rows[:-1])
        lone = alnum[ends] == alnum[starts]
        inner = (symbols[ends] > symbols[starts]) & ~lone
        letters = alnum[ends] - alnum[starts]
        short = (letters <= 3) & ~lone
        upper = total((data >= 65) & (data <= 90))
        caps = upper[ends] - upper[starts] > 1
        last = ends - 1
        doubled = (ends - starts > 1) & ~_ALNUM[data[last]] & (data[last] == data[np.maximum(last - 1, 0)]) & (data[last] < 128) if len(word) else np.zeros(0, bool)
        lines = sums(data == 10, bounds) + 1
        per = np.maximum(n, 1)
        self.measures = np.stack([sums(same, self.first) / per, sums(symbols[ends] - symbols[starts], self.first) / per, sums(lone, self.first) / per, c["n_repeat_words"] / per, sums(short, self.first) / per, c["n_dup_lines"] / lines, np.abs(c["word_chars"] / per - 5.5), sums(inner, self.first) / per, sums(caps, self.first) / per, sums(doubled, self.first) / per], 1)
        self.word = (word >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        self.shape = np.minimum(letters // 4, 7) + 8 * same + 16 * lone + 32 * inner + 64 * caps + 128 * doubled

    def votes(self) -> np.ndarray:
        """Matrix[row, labeller]: 0 bad, 1 good, 2 no vote."""
        out = np.full(self.measures.shape, 2, np.int8)
        for j, (_, kind, bad, good) in enumerate(LABELLERS):
            x = self.measures[:, j]
            out[(x >= bad) if kind == "rising" else (x <= bad), j] = 0
            out[(x <= good) if kind == "rising" else (x >= good), j] = 1
        out[self.n < 8] = 2
        return out

    def patterns(self) -> np.ndarray:
        return self.votes().astype(np.int64) @ 3 ** np.arange(len(LABELLERS))


def unpack(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float, np.ndarray]:
    """(rates[class, labeller, vote], share of good rows, posterior of good for each pattern). Starts from the vote's majority."""
    v = unpack(patterns)
    good, bad = (v == 1).sum(1), (v == 0).sum(1)
    post = np.where(bad > 0, 0.1, np.where(good > 0, 0.9, 0.5))
    rates, share = np.zeros((2, len(LABELLERS), 3)), 0.5
    if not len(patterns):
        return rates, share, post
    for _ in range(rounds):
        before = post
        weight = np.stack([counts * (1 - post), counts * post])
        for vote in range(3):
            rates[:, :, vote] = weight @ (v == vote)
        # Smoothing that leans on the labeller's own sense, so that classes can't change places.
        rates[0] += np.array([1.0, 0.2, 0.5])
        rates[1] += np.array([0.2, 1.0, 0.5])
        rates /= rates.sum(2, keepdims=True)
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        lean = np.log(share / (1 - share)) + (np.log(rates[1, np.arange(len(LABELLERS)), v]) - np.log(rates[0, np.arange(len(LABELLERS)), v])).sum(1)
        post = 1 / (1 + np.exp(-np.clip(lean, -40, 40)))
        if np.abs(post - before).max() < 1e-9:
            break
    return rates, float(share), post


class Scorer:
    """A logistic model of the shares of words by bucket and by shape."""

    def __init__(self):
        self.words, self.shapes, self.bias = np.zeros(1 << WORD_BITS), np.zeros(SHAPES), 0.0

    def logits(self, f: Features) -> np.ndarray:
        return sums(self.words[f.word] + self.shapes[f.shape], f.first) / np.maximum(f.n, 1) + self.bias

    def scores(self, f: Features) -> np.ndarray:
        return np.where(f.n > 0, 1 / (1 + np.exp(-np.clip(self.logits(f), -40, 40))), 0.0)


def fit(bodies: list[bytes], target: np.ndarray, how: Fit = Fit()) -> Scorer:
    """The scorer for texts with these chances of being good; both classes weigh alike."""
    model, r = Scorer(), np.random.default_rng(how.seed)
    width, parts, n = (1 << WORD_BITS) + SHAPES, [], []
    for at in portions([len(b) for b in bodies]):
        f = Features(np.frombuffer(b"".join(bodies[at]), np.uint8), np.r_[0, np.cumsum([len(b) for b in bodies[at]])].astype(np.int64))
        rows = np.repeat(np.arange(at.start, at.stop), f.n) * width
        parts.append(np.unique(np.concatenate([rows + f.word, rows + (1 << WORD_BITS) + f.shape]), return_counts=True))
        n.append(f.n)
    if not parts:
        return model
    n = np.concatenate(n)
    use = np.flatnonzero(n > 0)
    if not len(use):
        return model
    key, count = (np.concatenate(x) for x in zip(*parts))
    row, col = key // width, key % width
    value = count / n[row]
    first = np.searchsorted(row, np.arange(len(n) + 1))
    good = target[use].sum()
    weight = (target / max(good, 1e-3) + (1 - target) / max(len(use) - good, 1e-3)) * len(use) / 2
    weight = np.minimum(weight, 20)
    w, b, seen, seen_b = np.zeros(width), 0.0, np.full(width, 1e-8), 1e-8
    pull = np.r_[np.full(1 << WORD_BITS, 3e-4), np.full(SHAPES, 1e-6)]
    for _ in range(how.epochs):
        for at in np.array_split(r.permutation(use), max(1, len(use) // how.batch)):
            many = np.diff(first)[at]
            j = np.repeat(first[at] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            of = np.repeat(np.arange(len(at)), many)
            z = np.bincount(of, value[j] * w[col[j]], len(at)) + b
            e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target[at]) * weight[at] / len(at)
            g = np.bincount(col[j], value[j] * e[of], len(w)) + pull * w
            seen += g * g
            w -= how.rate * 6 * g / np.sqrt(seen)
            seen_b += e.sum() ** 2
            b -= how.rate * e.sum() / np.sqrt(seen_b)
    model.words, model.shapes, model.bias = w[: 1 << WORD_BITS], w[1 << WORD_BITS :], float(b)
    return model


SCHEMA = "doc_id long, score double, posterior double, kept boolean"


def learn(docs: DataFrame, how: Fit = Fit(), text: str = "text") -> tuple[Scorer, np.ndarray, np.ndarray]:
    """The scorer, and the vote patterns that occur with their posteriors."""
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                yield pa.RecordBatch.from_arrays([batch.column("_at"), pa.array(Features(*buffers(batch.column("_text"))).patterns()), pa.array(np.diff(buffers(batch.column("_text"))[1]) <= how.longest)], names=["_at", "pattern", "short"])

    body = text_of(text)
    base = docs.select(body.cast("binary").alias("_text"), F.xxhash64(body).alias("_at"))
    votes = cut(base.select("_at", "_text").mapInArrow(vote, "_at long, pattern long, short boolean"))
    histogram = votes.groupBy("pattern").count().collect()  # 3**10 rows at most
    patterns, counts = (np.array([r[i] for r in histogram], np.int64) for i in (0, 1))
    order = np.argsort(patterns)
    patterns, counts = patterns[order], counts[order].astype(np.float64)
    rates, share, post = expectation_maximisation(patterns, counts, how.em_rounds)
    # Half of the sample from the patterns that look bad, so that both classes are seen.
    looks_bad = F.col("pattern").isin(patterns[post < 0.5].tolist()) if (post < 0.5).any() else F.lit(False)
    half = how.most_texts // 2
    votes = votes.where("short")
    few = votes.where(looks_bad).dropDuplicates(["_at"]).orderBy("_at").limit(half).unionByName(votes.where(~looks_bad).dropDuplicates(["_at"]).orderBy("_at").limit(half))
    sample = base.where(F.octet_length("_text") <= how.longest).select("_at", "_text").join(few.select("_at", "pattern"), "_at").dropDuplicates(["_at"]).orderBy("_at").select("_text", "pattern").toLocalIterator()
    chance = dict(zip(patterns.tolist(), post.tolist()))
    pairs = [(bytes(r[0]), chance[r[1]]) for r in sample]
    return fit([p[0] for p in pairs], np.array([p[1] for p in pairs]), how), patterns, post


def quality_classifier(docs: DataFrame, threshold: float = 0.5, how: Fit = Fit(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, posterior, kept): one row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, how, text))  # fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, chances = shared.value
        for whole in batches:
            for batch in slices(whole, "_text"):
                f = Features(*buffers(batch.column("_text")))
                s = model.scores(f)
                p = chances[np.minimum(np.searchsorted(known, f.patterns()), len(known) - 1)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array(p), pa.array(s >= threshold)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).cast("binary").alias("_text")).mapInArrow(score, SCHEMA)


def only_good(docs: DataFrame, threshold: float = 0.5, how: Fit = Fit(), text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text scores at least the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, how, text))
    place = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value[0]
        for whole in batches:
            for batch in slices(whole, place):
                yield batch.filter(pa.array(model.scores(Features(*buffers(batch.column(place)))) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
