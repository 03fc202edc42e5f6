import hashlib
import random
from collections import Counter

import pytest

from phasegrid.llm.suffix_dedup import remove_repeats

L = 400


def brute(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[i : i + L] for _, b in texts for i in range(len(b) - L + 1))
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        for s in range(len(b) - L + 1):
            if count[b[s : s + L]] > 1:
                gone[s : s + L] = [True] * L
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((-1 if i is None else i, len(b), sum(gone), sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdefghij klmé") for _ in range(n))
    one, two = text(430), text(700)
    rows = []
    for i in range(36):
        if i % 3 == 0:
            rows.append((i, text(r.randint(0, 300)) + one + text(r.randint(0, 300))))
        elif i % 3 == 1:
            rows.append((i, text(r.randint(0, 200)) + two[r.randint(0, 150) : 700 - r.randint(0, 150)] + text(r.randint(0, 300))))
        else:
            rows.append((i, text(r.randint(0, 900))))
    return rows + [(100, "ab" * 900), (101, "x" * 1000), (102, None), (103, ""), (None, one), (None, one), (104, rows[5][1]), (5, rows[5][1]), (5, "short")]


@pytest.mark.parametrize("most", [3, 4096])
def test_equals_brute_force_also_where_keys_are_divided(spark, rows, most):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _text int")
    got = sorted((-1 if x[0] is None else x[0], *x[1:]) for x in remove_repeats(docs, most_blocks=most).collect())
    assert got == brute(rows)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_kept_text_is_valid(spark):
    one = "é" * 210
    got = remove_repeats(spark.createDataFrame([(1, "a" + one + "b"), (2, "c" + one + "d")], "doc_id long, text string"), with_text=True, whole_characters=True).orderBy("doc_id").collect()
    assert [bytes(x.kept).decode() for x in got] == ["ab", "cd"]


def test_transform_and_prefixes_equal_sorted_suffixes(tmp_path):
    import numpy as np

    from phasegrid.llm.suffix_dedup import PAD, Collection

    r = random.Random(8)
    blocks = [bytes(r.choice(b"abc") for _ in range(r.randint(6, 14))) for _ in range(40)]
    offs = np.array([r.randint(0, 5) for _ in blocks])
    held = Collection(blocks, offs, 4, str(tmp_path)).insert_columns()
    m, left, width = len(blocks), int(offs.max()), held.width
    rows = [bytes([PAD] * (left - o)) + b + bytes([PAD] * (width - left + o - len(b))) for b, o in zip(blocks, offs.tolist())]
    files = {n: (tmp_path / held.path.rsplit("/")[-1] / n).read_bytes() for n in ("transform", "prefixes")}
    prefixes, before = np.frombuffer(files["prefixes"], np.int32).reshape(width, m), list(range(m))
    for k, c in enumerate(range(width - 1, -1, -1)):
        # Suffixes from c + 1 in order, pads and full ties as they stood.
        assert files["transform"][k * m : k * m + m] == bytes(rows[i][c] for i in before)
        now = sorted(range(m), key=lambda i: (rows[i][c], before.index(i)))
        for a, b, got in zip(now, now[1:], prefixes[k][1:].tolist()):
            n = 0
            while n < 4 and c + n < width and rows[a][c + n] == rows[b][c + n] != PAD:
                n += 1
            assert got == n
        before = now
    assert [(c, o.tolist()) for c, o, _ in held.rows()][-1] == (0, before)
    held.remove()
    assert not list(tmp_path.iterdir())


def test_regular_strings_are_told_apart(spark):
    from test_stages import thue_morse

    docs = spark.createDataFrame([(1, thue_morse(1024)), (2, thue_morse(1024, "b", "a") + "c" * 30)], "doc_id long, text string")
    assert sorted(tuple(x) for x in remove_repeats(docs).collect()) == brute([(1, thue_morse(1024)), (2, thue_morse(1024, "b", "a") + "c" * 30)])


def test_text_beyond_a_piece(spark):
    r = random.Random(9)
    passage = "".join(r.choice("abcdefgh ") for _ in range(500))
    filler = "".join(r.choice("ijklmnop ") for _ in range(1 << 21))
    long = filler[:-250] + passage + filler[:5000][::-1]
    got = {x.doc_id: x for x in remove_repeats(spark.createDataFrame([(1, long), (2, "q" * 50 + passage)], "doc_id long, text string")).collect()}
    assert got[1].n_removed == 500 and got[2].n_removed == 500 and got[1].n_bytes == len(long)
