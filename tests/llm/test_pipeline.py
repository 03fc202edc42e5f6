"""The stages of the pipeline against plain Python on the smallest tables; contract queries with SQL against DuckDB."""

import hashlib
import os
import re
from collections import Counter

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def one_of_each(rows):
    sets = [shingles(r.text) for r in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                up[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        least[top(i)] = min(least.get(top(i), r.doc_id), r.doc_id)
    return {r.doc_id for i, r in enumerate(rows) if not sets[i] or least[top(i)] == r.doc_id}


def trimmed(rows, length):
    texts = {r.doc_id: r.text.encode() for r in rows if r.text is not None}
    seen = Counter(b[i : i + length] for b in texts.values() for i in range(len(b) - length + 1))
    out = {r.doc_id: None for r in rows}
    for d, b in texts.items():
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        # Removed runs shrink to whole characters.
        kept, at = bytearray(), 0
        while at < len(b):
            end = at + 1
            while end < len(b) and b[end] & 0xC0 == 0x80:
                end += 1
            if not all(gone[at:end]):
                kept += b[at:end]
            at = end
        out[d] = kept.decode()
    return out


def test_stages(spark):
    import corpus_pipeline as p
    from phasegrid.llm import toxicity, weak_labels
    from phasegrid.llm.common import scratch

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    want = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 0").collect()}
    assert [n for n, _ in p.STAGES] == ["toxicity", "quality", "near_dedup", "suffix_dedup", "packing"]
    for name, stage in p.STAGES:
        rows = docs.collect()
        got = stage(spark, docs, SF)
        if name == "packing":
            packed = got.collect()
            words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
            assert {d: sum(x.n_tokens for x in packed if x.doc_id == d) for d in words} == words
            break
        assert got.columns == columns
        got.write.parquet(path := scratch(spark, f"test-{name}"))
        after = spark.read.parquet(path)
        kept = {r.doc_id: r for r in after.collect()}
        if name == "toxicity":
            assert set(kept) == want
        elif name == "quality":
            assert set(kept) == {r.doc_id for r in weak_labels.quality_classifier(docs).where("kept").collect()}
        elif name == "near_dedup":
            assert set(kept) == one_of_each(rows)
        else:
            assert {d: r.text for d, r in kept.items()} == trimmed(rows, p.PASSAGE)
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept.values())
        docs = after


@pytest.mark.parametrize("name", ["op2_suffix_dedup", "op7_threshold_topk", "op9_warc_segments", "op10_minmax_near_dedup"])
def test_contract_queries_equal_sql(spark, name):
    import duckdb

    from phasegrid.llm import queries

    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF).select(*names).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want.fetchall()))


def test_band_verdicts_follow_from_the_ratios(spark):
    import numpy as np
    import zstandard

    from phasegrid.llm.quality_rules import Bands, compression_bands

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bands, press = Bands(), zstandard.ZstdCompressor(level=3, write_content_size=False)
    ratio = lambda b: len(b) / len(press.compress(b))
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for x in compression_bands(docs).collect():
        b = text[x.doc_id]
        at = next(i for i, u in enumerate(bands.upto) if len(b) <= u)
        high = low = False
        if b:
            chunks = [b[i : i + bands.chunk] for i in range(0, len(b) - bands.chunk + 1, bands.chunk)] + ([b[-bands.chunk :]] if len(b) >= bands.chunk else [])
            each = [ratio(c) for c in chunks] or [ratio(b)]
            high = ratio(b) > bands.most[at] or max(each) > bands.chunk_most
            low = ratio(b) < bands.least[at] or len(b) >= bands.chunk and min(each) < bands.chunk_least
        assert x.kept == (not x.base_failed and not high and not low) or not b, x
    assert np.mean([x.kept for x in compression_bands(docs).collect()]) > 0.3


def test_digests_are_of_whole_texts():
    from phasegrid.llm.suffix_dedup import digests
    import numpy as np

    data = np.frombuffer(b"abcabc", np.uint8)
    one, two, three = digests(data, np.array([0, 3, 0]), np.array([3, 6, 3]), np.array([0, 0, 1]))
    assert one == two != three and hashlib.blake2b(b"abc", digest_size=8, salt=b"\0\0\0\0").digest() == one.tobytes()
