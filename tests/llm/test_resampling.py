import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

from phasegrid.llm import resampling
from phasegrid.llm.resampling import Plan, Table, resample

DOCS = "doc_id long, text string, _place long, score string, _short int"


def features(text, plan):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in range(plan.least, plan.most + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, plan):
    bucket = lambda f: zlib.crc32(f.encode()) % plan.buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x, plan)[1]) for texts in ([x for _, x in docs], target))
    a, b = sum(s.values()) + plan.buckets, sum(t.values()) + plan.buckets
    rows = []
    for i, text in docs:
        n, found = features(text, plan)
        gain = [math.floor(1000 * math.log((t[bucket(f)] + 1) * a / ((s[bucket(f)] + 1) * b))) for f in found]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{plan.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n))
    able = sorted((r for r in rows if r[4] >= plan.min_words), key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[1]))
    drawn = able[: plan.percent * len(able) // 100]
    return Counter((*r, drawn.index(r) + 1 if r in drawn else None) for r in rows)


def some(seed, n):
    r = random.Random(seed)
    vocabulary = [f"{chr(97 + k % 26)}{k}" for k in range(80)] + ["É", "ß", "ÀB", "x" * 40, "y" * 31, "z" * 32]
    return [" ".join(r.choices(vocabulary, k=r.randint(0, 60))) for _ in range(n)]


def test_same_as_plain_python(spark):
    texts = [None, "", " \n", "one", "Ab-aB_ab,AB", "w" * 300_000, "Long one " * 30_000, *some(1, 60)]
    docs = list(enumerate(texts)) + [(None, "a b c " * 9)]
    target = [None, *some(2, 9)]
    for plan in (Plan(), Plan(1, 2, 97, 7, 5, 40), Plan(2, 3, 1000, 1, 0, 100)):
        given = spark.createDataFrame([(i, t, 0, "s", 1) for i, t in docs], DOCS)
        got = resample(given, spark.createDataFrame([(t, 1) for t in target], "text string, n int"), plan).collect()
        assert Counter((x.doc_id, x.n_features, x.weight, x.score, x.n_words, x.rank) for x in got) == plain(docs, target, plan)


def test_equal_rows_ties_and_empty_tables(spark):
    given = spark.createDataFrame([(4, "a b c d", 0, "", 0)] * 10 + [(3, "a b c d", 0, "", 0)], DOCS)
    empty = spark.createDataFrame([], DOCS)
    got = resample(given, empty, Plan(min_words=1, percent=50)).collect()
    assert sorted(x.rank for x in got if x.rank) == [1, 2, 3, 4, 5]
    assert len({(x.doc_id, x.score) for x in got}) == 2 and len({x.weight for x in got}) == 1
    assert resample(empty, given).collect() == []


def test_hash_and_table_when_keys_clash():
    r = random.Random(5)
    parts = [bytes(r.randrange(97, 100) for _ in range(r.randint(0, 70) if r.random() < 0.5 else 2)) for _ in range(2000)]
    data, b = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
    assert resampling.xxh64(data, b[:-1], b[1:]).tolist() == [xxhash.xxh64_intdigest(p) for p in parts]
    for keys in (None, np.zeros(len(parts), np.uint64)):  # all keys equal: only the bytes part them
        t = Table(data, b[:-1], b[1:], 50, keys)
        assert len({(p, s) for p, s in zip(parts, t.slot.tolist())}) == len(set(parts)) == len(set(t.slot.tolist()))
        assert all(t.bucket[s] == zlib.crc32(p) % 50 and t.count[s] == n for p, n in Counter(parts).items() for s in [t.slot[parts.index(p)]])
