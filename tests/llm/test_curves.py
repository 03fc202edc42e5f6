import os
import random

import numpy as np
import pytest

from phasegrid.llm import quality_rules
from phasegrid.llm.quality_rules import Bands, Curve, compression_bands

SF = "/root/testdata/sf0.01"
SHAPE = "doc_id long, text string, lang string, n_bytes int, mark string, _lang int"


def prose(r, n):
    stems = "tion er the an ing on re st ha ed wh and lo mi ka su pe ro ti be cu da fo gu ni vi pra clo dre sto".split()
    return " ".join("".join(r.choices(stems, k=r.randint(1, 3))) for _ in range(n))


def test_both_kinds_of_junk_fall_and_copies_move_nothing(spark):
    r = random.Random(1)
    good = [prose(r, r.randint(100, 900)) for _ in range(400)]
    copies = ["again " + good[0]] * 400  # a third of all rows
    marks = [" ".join(w + "***" for w in prose(r, 300).split()) for _ in range(20)]
    noise = [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJ", k=9)) for _ in range(300)) for _ in range(20)]
    huge = prose(r, 600_000)
    texts = good + copies + marks + noise + [None, "", huge]
    got = {x.doc_id: x for x in compression_bands(spark.createDataFrame([(i, t, "en" if i % 9 else None, 0, "", 1) for i, t in enumerate(texts)], SHAPE)).collect()}
    assert len(got) == len(texts)
    n = len(good)
    assert sum(got[i].kept for i in range(n)) >= 0.985 * n and all(got[n + i].kept for i in range(400))
    at = n + 400
    assert sum(got[at + i].reason == "repetitive" for i in range(20)) >= 18 and sum(got[at + 20 + i].reason == "incompressible" for i in range(20)) >= 18
    assert got[at + 40].reason == got[at + 41].reason == "base" and got[at + 42].n_words == 600_000


def test_few_texts_and_no_language_column(spark):
    r = random.Random(2)
    df = spark.createDataFrame([(i, prose(r, 200)) for i in range(5)], "doc_id long, text string")
    assert all(x.kept for x in compression_bands(df).collect())
    assert compression_bands(df.limit(0)).collect() == []


def test_curve_widens_beyond_known_lengths():
    c = Curve(np.array([8.0, 10.0]), np.array([1.5, 1.8]), {8: 0.02, 9: 0.04})
    middle, spread = c.around(np.array([9.0, 10.1, 14.0]))
    assert middle.tolist() == [1.65, 1.8, 1.8] and spread[0] == 0.04 and spread[1] == pytest.approx(0.04) and spread[2] == pytest.approx(0.04 + 0.15 * 3.75)
    assert quality_rules._middle(np.array([3.0, 1.0, 2.0]), np.array([1, 1, 5])) == 2.0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_given_junk_goes_and_good_texts_stay(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = compression_bands(spark.read.parquet(f"{SF}/documents.parquet"), Bands()).join(labels, "doc_id").collect()
    bad = [x for x in rows if x.quality == 0]
    good = [x for x in rows if x.quality == 1 and not x.base_failed]
    assert sum(not x.kept for x in bad) >= 0.88 * len(bad) and sum(not x.kept for x in good) <= 0.01 * len(good)
