import random

import numpy as np

from phasegrid.llm import minhash
from phasegrid.llm.minhash import near_duplicates


def brute(rows, k, percent=80):
    import re

    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def top(x):
        return x if up[x] == x else top(up[x])

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(top(i), []).append(d)
    return sorted((d, len(sets[i]), min(least[top(i)])) for i, (d, _) in enumerate(rows))


def edited(r, words, share):
    return [r.choice("abcdefgh") * 3 + str(r.random()) if r.random() < share else w for w in words]


def test_equals_brute_force_with_chains_and_large_groups(spark, monkeypatch):
    r = random.Random(3)
    rows, chain = [], [f"w{r.randint(0, 9999)}" for _ in range(120)]
    for i in range(12):  # a chain in which only neighbours are linked, and copies of one text with many edits
        rows.append((i, " ".join(chain)))
        chain = edited(r, chain, 0.03)
    base = [f"v{r.randint(0, 9999)}" for _ in range(150)]
    rows += [(100 + i, " ".join(edited(r, base, 0.05))) for i in range(36)]
    rows += [(200, "Hello"), (201, "hello"), (202, ""), (203, None), (204, " \n"), (205, "one two"), (206, "One TWO three"), (207, rows[0][1].upper())]
    rows = [(500 - d, t) for d, t in rows]
    docs = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, nid string")
    monkeypatch.setattr(minhash, "BLOCK", 16)
    for k in (1,):
        got = near_duplicates(docs, k=k).collect()
        assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == brute(rows, k)
        assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_null_ids_and_empty_table(spark):
    got = near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (None, "x y z"), (7, "a b c d e f")], "doc_id long, text string")).collect()
    assert sorted((str(x.doc_id), str(x.component_id)) for x in got) == [("7", "7"), ("7", "7"), ("None", "7"), ("None", "None")]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_band_agreement_is_unbiased():
    r = np.random.default_rng(1)
    both = r.integers(0, 1 << 63, 800, dtype=np.uint64)
    a, b = np.r_[both, r.integers(0, 1 << 63, 100, dtype=np.uint64)], np.r_[both, r.integers(0, 1 << 63, 100, dtype=np.uint64)]
    keys = minhash.band_keys(np.r_[a, b], np.array([0, 900, 1800]))
    assert 5 < (keys[0] == keys[1]).sum() < 40  # 44 * 0.8 ** 6 = 11.5
