import os

import numpy as np
import pytest

from phasegrid.llm import weak_labels

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_junk_goes_and_good_texts_stay(spark):
    """labels only measure: no labelled row is used in the fit."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    got = weak_labels.quality_classifier(spark.read.parquet(f"{SF}/documents.parquet")).join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    bad, good = ({k: n.get((q, k), 0) for k in (False, True)} for q in (0, 1))
    assert bad[False] >= 0.9 * sum(bad.values()) and good[False] <= 0.03 * sum(good.values())


def test_measures_as_plain_python():
    texts = ["LOUD!! LOUD!! words here", "a*** b%%% c ok", "", "é!! é", "x" * 3_000_000, "Aa bB CC D 1!! .. ,"]
    body = [t.encode() for t in texts]
    f = weak_labels.Features(np.frombuffer(b"".join(body), np.uint8), np.r_[0, np.cumsum([len(b) for b in body])].astype(np.int64))
    for row, t in zip(f.measures, texts):
        w = [x.encode() for x in t.split()]
        caps = sum(sum(65 <= c <= 90 for c in x) > 1 for x in w)
        doubled = sum(len(x) > 1 and x[-1] == x[-2] and x[-1] < 128 and not chr(x[-1]).isalnum() for x in w)
        assert row[8] == pytest.approx(caps / max(len(w), 1)) and row[9] == pytest.approx(doubled / max(len(w), 1))


def posterior(patterns, counts, rounds):
    """Expectation-maximisation in plain loops."""
    m = len(weak_labels.LABELLERS)
    votes = [[p // 3**j % 3 for j in range(m)] for p in patterns]
    post = [0.1 if 0 in v else 0.9 if 1 in v else 0.5 for v in votes]
    for _ in range(rounds):
        rates = [[[1.0, 0.2, 0.5] if c == 0 else [0.2, 1.0, 0.5] for _ in range(m)] for c in (0, 1)]
        for v, n, g in zip(votes, counts, post):
            for j in range(m):
                rates[0][j][v[j]] += n * (1 - g)
                rates[1][j][v[j]] += n * g
        rates = [[[x / sum(r) for x in r] for r in c] for c in rates]
        share = (sum(n * g for n, g in zip(counts, post)) + 1) / (sum(counts) + 2)
        out = []
        for v in votes:
            odds = share / (1 - share)
            for j in range(m):
                odds *= rates[1][j][v[j]] / rates[0][j][v[j]]
            out.append(odds / (1 + odds))
        post = out
    return post


def test_expectation_maximisation_as_plain_python():
    r = np.random.default_rng(1)
    patterns = np.unique(r.integers(0, 3 ** len(weak_labels.LABELLERS), 40))
    counts = r.integers(1, 50, len(patterns)).astype(float)
    _, _, got = weak_labels.expectation_maximisation(patterns, counts, 7)
    assert np.allclose(got, posterior(patterns.tolist(), counts.tolist(), 7), atol=1e-9)
