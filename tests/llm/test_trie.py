import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from phasegrid.llm.trie import Shape, SpillingQueue, borrowed_heads, prefix_trie, whole_paths

TURNS = "conv_id long, turn long, role string, text string, depth string, conv int, key string"


def plain(rows, base=lambda c: c, h=lambda c: 0):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((-1, 0) if turn is None else (0, turn), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in convs.items()}
    built = {c: own.get(base(c), [])[: h(c)] + v[h(c) :] for c, v in own.items()}
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(built):
        path = tuple(built[c])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                kids[path[: d - 1]].add(path[:d])
        ends[path].append(c)
    leaves, saved, out = {}, {}, Counter()
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        digest = hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()
        out[(members[node][0], len(node), members[node[:-1]][0] if node else None, len(members[node]), len(kids[node]), leaves[node], saved[node], digest)] += 1
    return out


def given(spark, rows, n=5):
    return spark.createDataFrame([(*r, "x", 1, "k") for r in rows], TURNS).repartition(n)


def rows_of(df):
    return Counter(tuple(x) for x in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def some(seed, convs, longest, words=3):
    r = random.Random(seed)
    out = []
    for c in r.sample(range(1000), convs):
        for t in range(r.randint(1, longest)):
            out.append((c, None if r.random() < 0.1 else r.randint(0, longest), r.choice(["user", None, ""]), r.choice(["é" * k for k in range(words)] + [None])))
    return out


@pytest.mark.parametrize("shape", [Shape(), Shape(heavy=2, band=2, queue=3), Shape(heavy=7, band=1, queue=100), Shape(heavy=1000, band=3, queue=2)])
def test_same_as_plain_python(spark, shape):
    rows = some(3, 60, 7) + [(None, 1, "user", "no id")] + [(5, 1, "a", "b")] * 3 + [(2000, t, "u", f"t{t}") for t in range(300)] + [(2001, t, "u", f"t{t}") for t in range(290)]
    assert rows_of(prefix_trie(whole_paths(given(spark, rows)), shape)) == plain(rows)


def test_borrowed_heads(spark):
    rows = some(4, 120, 6)
    h = lambda c: zlib.crc32(str(c).encode()) % 6
    own = F.col("conv_id")
    paths = borrowed_heads(given(spark, rows), own - own % 100, F.crc32(own.cast("string")) % 6, most=5)
    assert rows_of(prefix_trie(paths, Shape(heavy=5, band=2, queue=4))) == plain(rows, lambda c: c - c % 100, h)


def test_one_conversation_over_many_tasks_and_no_rows(spark):
    rows = [(7, i, "u", str(i % 3)) for i in range(3000)] + [(8, i, "u", str(i % 3)) for i in range(1500)]
    assert rows_of(prefix_trie(whole_paths(given(spark, rows, 1)), Shape(band=64))) == plain(rows)
    assert prefix_trie(whole_paths(given(spark, []))).collect() == []


def test_queue_spills_and_keeps_order():
    r = random.Random(1)
    queue, held = SpillingQueue(10), []
    for _ in range(5000):
        if held and r.random() < 0.4:
            assert queue.least() == min(held)
            held.remove(queue.pop())
        else:
            held.append((r.randint(0, 50), r.randint(0, 9)))
            queue.push(held[-1])
    assert queue.files and [queue.pop() for _ in held] == sorted(held)
    queue.close()
