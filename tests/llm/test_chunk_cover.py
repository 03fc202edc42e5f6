"""Chunks cover every text to its end, and one chunk of noise is enough."""

import random

import zstandard

from phasegrid.llm import quality_rules


def prose(n, seed=3):
    r = random.Random(seed)
    pool = ["".join(r.choices("etaoinshrdlu", k=r.randint(3, 9))) for _ in range(3000)]
    text = ""
    while len(text) < n:
        text += r.choice(pool) + " "
    return text[:n]


def judged(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {x.doc_id: x for x in quality_rules.compression_bands(df).collect()}


def test_tail_and_noise_chunks(spark):
    r = random.Random(4)
    noise = " ".join("".join(chr(r.randint(33, 126)) for _ in range(9)) for _ in range(205))[:2048]
    tail = prose(20 * 2048) + ("word " * 400)[:1900]
    got = judged(spark, [prose(20 * 2048), tail, prose(10 * 2048) + noise + prose(10 * 2048, 5), prose(1100) + ("word " * 400)[:1900]])
    assert got[0].kept
    assert got[1].reason == "repetitive"
    assert got[2].reason == "incompressible"
    assert got[3].chunk_most > got[3].whole_ratio  # a text between one and two chunks has chunks as well


def test_last_chunk_ends_at_the_end():
    press = zstandard.ZstdCompressor(level=3)
    bands = quality_rules.Bands()
    body = prose(5000).encode()
    each = [2048 / len(press.compress(body[i : i + 2048])) for i in (0, 2048, 5000 - 2048)]
    assert quality_rules.ratios(body, bands, press)[1:] == (max(each), sorted(each)[1], min(each))
