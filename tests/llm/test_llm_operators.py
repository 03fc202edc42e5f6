import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from test_stages import thue_morse

from phasegrid.llm import packing, pieces, quality_rules, sharding, topk, toxicity, warc, weak_labels

DOCS = "doc_id long, text string, _text int, n long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " \n\t ", "one", "é" * 50, "a b c " * 400, "x" * 20_000, "word\n" * 30, "word\n" * 30]


# ---- packing ----


def test_bounds_are_optimal():
    r = random.Random(1)
    for _ in range(20):
        h = {r.randint(0, 40): r.randint(1, 9) for _ in range(9)}
        bounds, cost = packing.best_bounds(h, 3)
        lengths = sorted(h)
        best = min(sum(n * (min(b for b in (*c, lengths[-1]) if b >= x) - x) for x, n in h.items()) for c in itertools.combinations(lengths, 2))
        assert cost == best == sum(n * (min(b for b in bounds if b >= x) - x) for x, n in h.items())


def test_batches_hold_every_token_within_the_budget(spark):
    r = random.Random(2)
    texts = [" ".join(["w"] * r.randint(0, 90)) for _ in range(300)] + ODD
    got = packing.pack(docs(spark, texts), n_buckets=4, budget=128, max_len=50).collect()
    want = {i: len((t or "").split()) for i, t in enumerate(texts)}
    for i, n in want.items():
        own = sorted((x.piece, x.start, x.n_tokens) for x in got if x.doc_id == i)
        assert sum(x[2] for x in own) == n and [x[1] for x in own] == [50 * k for k in range(max(1, -(-n // 50)))]
    per = {}
    for x in got:
        assert x.n_tokens <= x.bucket_len
        per.setdefault((x.batch, x.bucket, x.bucket_len), []).append(x.slot)
    assert len({b for b, _, _ in per}) == len(per)
    for (_, _, size), slots in per.items():
        assert sorted(slots) == list(range(len(slots))) and (len(slots) * size <= 128 or len(slots) == 1)
    assert packing.pack(docs(spark, [])).collect() == []


# ---- compression bands ----


def test_counts_match_plain_python(spark):
    texts = [*ODD, "A b\nA b\n\nc d e f g h i j k l m n o p q r s\nA b", "# $ word| " + " ".join(f"w{i % 9}" for i in range(60)), " ".join(str(i * i) for i in range(3000))]
    got = {x.doc_id: x for x in quality_rules.compression_bands(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        covered = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(8)} if len(windows) < 2000 else set()
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert x.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (x.base_failed and x.kept)
        if t:
            whole = len(t.encode()) / len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(t.encode()))
            assert x.whole_ratio == pytest.approx(whole)


def test_lines_of_regular_structure_are_told_apart(spark):
    lines = thue_morse(1024) + "\n" + thue_morse(1024, "b", "a")
    assert quality_rules.compression_bands(docs(spark, [lines])).first().n_dup_lines == 0


def test_repetition_and_noise_are_rejected(spark):
    r = random.Random(3)
    syllables = [a + b for a in "bdfgklmnprstvw" for b in ("a", "e", "i", "on", "u", "er")]
    prose = " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(600))
    cycle = " ".join(f"{a} {b}" for a, b in itertools.product(["stone", "river", "glass"], range(300)))
    noise = " ".join(bytes(r.choice(range(33, 127)) for _ in range(400)).decode() for _ in range(30))
    got = {x.doc_id: x.reason for x in quality_rules.compression_bands(docs(spark, [prose, cycle, noise])).collect()}
    assert got == {0: "", 1: "repetitive", 2: "incompressible"}


# ---- toxicity and quality ----


def made_up(r, n, bad=()):
    words = ["".join(r.choice(["th", "er", "on", "an", "re", "in"]) for _ in range(r.randint(1, 4))) for _ in range(n)]
    for b in bad:
        words[r.randrange(n)] = b
    return " ".join(words)


def test_network_gradient_matches_differences():
    net = toxicity.Network(1)
    t = toxicity._tables([b"some words to test the gradient with", b"two"])
    _, start, n = t.windows()
    x = net.inputs(t).astype(np.float64)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    y, w = np.array([1.0, 0.0]), np.ones(2)
    g, dx = net.gradient(x, start, n, y, w)

    def loss():
        z = net.forward(x, start, n)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    for name, at in (("Wf", (3, 5)), ("Ub", (2, 17)), ("va", (1,)), ("bf", (20,)), ("wo", (4,))):
        old, e = net.p[name][at], 1e-3
        net.p[name][at] = old + e
        up = loss()
        net.p[name][at] = old - e
        down = loss()
        net.p[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / (2 * e), abs=2e-4)
    assert dx.shape == x.shape


def test_toxic_words_are_found_in_held_out_texts(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(420):
        toxic = i % 3 == 0
        rows.append((i, made_up(r, r.randint(30, 120), r.sample(["vilgar", "stupido", "moronik"], 3) if toxic else ()), 1))
        labels.append((i, int(toxic)))
    rows += [(1000, "", 0), (1001, None, 0)]
    got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string, score int"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")).collect()
    assert len(got) == 422 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got)
    held = [x for x in got if x.held_out and x.doc_id < 1000]
    assert np.mean([x.predicted == (x.doc_id % 3 == 0) for x in held]) > 0.9


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [x.score for x in toxicity.toxicity(docs(spark, ["a b"]), none).collect()] == [0.5]
    assert toxicity.toxicity(docs(spark, []), none).collect() == []


def test_em_recovers_accuracies():
    r = np.random.default_rng(5)
    k = len(weak_labels.LABELLERS)
    truth = r.random(20_000) < 0.7
    right = np.linspace(0.95, 0.7, k)
    votes = np.where(r.random((20_000, k)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[r.random((20_000, k)) < 0.2] = 2
    p, c = np.unique(votes @ 3 ** np.arange(k), return_counts=True)
    rates, share, post = weak_labels.expectation_maximisation(p, c.astype(float))
    assert share == pytest.approx(0.7, abs=0.02)
    assert rates[1, :, 1] / (rates[1, :, 0] + rates[1, :, 1]) == pytest.approx(right, abs=0.03)
    got = post[np.searchsorted(p, votes @ 3 ** np.arange(k))] > 0.5
    assert (got == truth).mean() > 0.97


def test_quality_tells_prose_from_junk(spark):
    r = random.Random(6)
    good = [made_up(r, r.randint(60, 200)).replace("on ", "on, ") for _ in range(150)]
    junk = [" ".join([made_up(r, 1)] * 80) for _ in range(20)] + [" | ".join(made_up(r, 1) + "re" for _ in range(80)) for _ in range(20)] + [" ".join(w + "$$%" for w in made_up(r, 80).split()) for _ in range(20)]
    got = {x.doc_id: x.kept for x in weak_labels.quality_classifier(docs(spark, good + junk + [None, ""])).collect()}
    assert np.mean([got[i] for i in range(150)]) > 0.97 and np.mean([got[150 + i] for i in range(60)]) < 0.05
    assert not got[210] and not got[211]
    assert weak_labels.quality_classifier(docs(spark, [])).collect() == []


def test_filters_keep_columns(spark):
    d = docs(spark, [*ODD, *["plain words that make a short text " + str(i) for i in range(20)]])
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    assert toxicity.without_toxic(d, labels).columns == weak_labels.only_good(d).columns == d.columns
    assert weak_labels.only_good(d).count() <= d.count()


# ---- sharding ----


def test_curve_visits_every_cell_by_single_steps(spark):
    for n, bits in ((2, 3), (3, 2)):
        side = 1 << bits
        cells = spark.createDataFrame(list(itertools.product(range(side), repeat=n)), ", ".join(f"c{i} int" for i in range(n)))
        rows = cells.withColumn("h", sharding.hilbert([F.col(f"c{i}") for i in range(n)], bits)).orderBy("h").collect()
        assert [x.h for x in rows] == list(range(side**n))
        assert all(sum(abs(a - b) for a, b in zip(x[:n], y[:n])) == 1 for x, y in zip(rows, rows[1:]))


def test_shards_are_even_and_slots_gapless(spark):
    d = spark.createDataFrame([(i if i % 10 else None, None if i % 7 == 0 else "té" * (i % 40), f"s{i % 3}" if i % 5 else None, "en", i) for i in range(500)], "doc_id long, text string, source string, lang string, size int")
    got = sharding.hilbert_shards(d).collect()
    per = {}
    for x in got:
        per.setdefault(x.shard, []).append(x.slot)
    assert sorted(per) == list(range(24)) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    assert all(x.curve <= y.curve for x, y in zip(sorted(got, key=lambda x: (x.shard, x.slot)), sorted(got, key=lambda x: (x.shard, x.slot))[1:]))
    one = next(x for x in got if x.doc_id == 13)
    assert (one.size, one.text_crc32) == (8 + 3 * 13, zlib.crc32(("té" * 13).encode()))
    assert sharding.hilbert_shards(d.limit(0)).collect() == []


def test_equal_texts_share_a_curve_position(spark):
    d = spark.createDataFrame([(i, f"text {i % 7} " * (1 + i % 7), f"s{i % 5}", f"l{i % 3}") for i in range(300)], "doc_id long, text string, source string, lang string")
    got = sharding.hilbert_shards(d).collect()
    per = {}
    for x in got:
        per.setdefault(x.text_crc32, set()).add(x.curve)
    assert len(per) == 7 and all(len(c) == 1 for c in per.values())


def test_every_row_is_written(spark, tmp_path):
    d = spark.createDataFrame([(None, "a", "s", "en", 1), (None, "a", "s", "en", 2), (3, None, None, None, 3), (3, "b", "s", "en", 4)], "doc_id long, text string, source string, lang string, size int")
    sharding.write_shards(d, str(tmp_path / "s"), n_shards=2)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(x["size"] for x in back.collect()) == [1, 2, 3, 4] and {x.shard for x in back.collect()} == {0, 1}


def test_written_shards_can_be_pruned(spark, tmp_path):
    d = spark.createDataFrame([(i, "x" * i, f"s{i % 3}", "en") for i in range(100)], "doc_id long, text string, source string, lang string")
    bounds = sharding.write_shards(d, str(tmp_path / "s"), n_shards=4)
    assert bounds.agg(F.sum("n_rows")).first()[0] == 100 and spark.read.parquet(str(tmp_path / "s")).where("shard = 2").count() == 25


# ---- top k ----


def test_top_products_match_brute_force(spark):
    r = np.random.default_rng(7)
    x = np.round(r.normal(size=(150, 6)), 1)
    x[20:30] = x[10]
    rows = [(i, [float(v) for v in np.float32(a)], "z") for i, a in enumerate(x)]
    rows += [(200, None, ""), (250, [1.0, None, 0.0, 0.0, 0.0, 0.0], ""), (None, [9.0] * 6, ""), (251, [float("nan")] * 6, ""), (252, [float("inf")] * 6, ""), (300, [0.0] * 6, ""), (7, [5.0] * 6, "repeat")]
    got = topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>, items string"), F.col("vec_id") % 50 == 0)
    sound = [(i, [int(np.floor(256 * float(np.float32(v)))) for v in e]) for i, e, _ in rows if i is not None and e is not None and all(v is not None and np.isfinite(v) for v in e)]
    want = []
    for q, a in sound:
        if q % 50 == 0:
            best = sorted((-sum(map(int.__mul__, a, b)), i) for i, b in sound if i != q)[:5]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)
    assert topk.top_products(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect() == []


def test_rounds_of_blocks_give_the_same_rows(spark, monkeypatch):
    r = np.random.default_rng(17)
    x = r.integers(-40, 40, (400, 5)) / 8
    df = spark.createDataFrame([(i, [float(v) for v in a]) for i, a in enumerate(x)], "vec_id long, embedding array<double>")
    one = sorted(tuple(x) for x in topk.top_products(df, F.col("vec_id") % 50 == 0).collect())
    monkeypatch.setattr(topk, "BLOCK", 16)
    assert sorted(tuple(x) for x in topk.top_products(df, F.col("vec_id") % 50 == 0).collect()) == one
    q = x.astype(int) * 0 + np.floor(256 * x).astype(int)
    want = [(i, k, j, s) for i in range(0, 400, 50) for k, (s, j) in enumerate(sorted(((-int(q[i] @ q[j]), j) for j in range(400) if j != i))[:5], 1) for s in [-s]]
    assert one == sorted(want)


def test_walk_stops_early():
    r = np.random.default_rng(8)
    rows = r.integers(-50, 50, (4000, 3))
    down = np.argsort(-rows, axis=0, kind="stable").T
    _, scores, read = topk.threshold_walk(rows, np.arange(4000), down, np.array([9, -5, 1]), -1, 5)
    assert scores[0] == (rows @ [9, -5, 1]).max() and read < 2000


# ---- pieces ----


@pytest.fixture(scope="module")
def model():
    public = pytest.importorskip("public_tokenizers")
    return public.path("piece_bpe_32k.model")


def test_ids_equal_the_library(spark, model):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=model)
    r = random.Random(9)
    texts = ["", " a", "a  b", "x ", "  ", " " * 47 + "x", "日本語☃ é \n\t", "a\x00b", "ha" * 90, "▁▁a", "1234 89.00", "Straße ñandú"]
    texts += ["".join(r.choice("abcdeéß 日語☃\n.,ETH  ") for _ in range(r.randint(0, 80))) for _ in range(300)]
    p = pieces.load(model)
    coded = pieces.encode(docs(spark, [None, *texts]), p)
    got = {x.doc_id: list(x.ids) for x in coded.collect()}
    assert got.pop(0) == [] and [got[i + 1] for i in range(len(texts))] == sp.encode(texts)
    regular = [thue_morse(2048, a, b) + " " + thue_morse(2048, b, a) for a, b in ("ae", "th", "on")]
    long = {x.doc_id: list(x.ids) for x in pieces.encode(docs(spark, [*regular, "ha" * 3000]), p).collect()}
    assert [long[i] for i in range(4)] == sp.encode([*regular, "ha" * 3000])
    back = {x.doc_id: x.text for x in pieces.decode(coded, p).collect()}
    assert [back[i + 1] for i in range(len(texts))] == [sp.decode(w) for w in sp.encode(texts)]
    assert pieces.encode(docs(spark, []), p).collect() == []


def test_other_models_are_refused(tmp_path):
    for body in (b"\x12\x02\x18\x01", b"\x12\x02\x18\x02", b""):  # unigram; BPE without byte fallback; nothing
        (tmp_path / "m.model").write_bytes(body)
        with pytest.raises(ValueError):
            pieces.load(str(tmp_path / "m.model"))


# ---- archives ----


def test_framing():
    body = b"x" * 9000 + b"\r\n0\r\n\r\n"
    assert warc.unchunked(warc.chunked(body)) == body and warc.unchunked(b"5;ext=1\r\nhello\r\n0\r\nTrailer: 1\r\n\r\n") == b"hello"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nhel")


def test_pages_come_back(spark):
    long = "<p>é</p>" * 900
    pages = [(1, "http://a/ b", long), (2, "http://b", "short"), (3, None, long), (4, "u", None), (5, "u", "short"), (None, "u", long), (0, "u", "<p>" + "y" * 200), (9, "u", "<p>" + "y" * 200), (9, "u", "<p>" + "y" * 200), (6, "u", "WARC/1.1\r\n\r\n" * 300)]
    got = warc.round_trip(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, block int"), segment=1000).collect()
    first = {}
    for i, _, h in pages:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, 99), i)
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        to = first.get(h) if len(b) >= 100 and first.get(h) != i else None
        want.append((str(i), len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", str(to)))
    assert sorted((str(x.page_id), x.payload_bytes, x.payload_digest, x.record_type, str(x.refers_to)) for x in got) == sorted(want)
    assert {x.status for x in got} == {"ok"}


def test_damage_is_told(spark):
    schema = warc.RECORDS
    rows = [("<a>", "response", 1, "u", None, None, None, 1, None, b"HTTP/1.1 200\r\n\r\nab"), ("<a:2>", "continuation", None, None, None, None, "<a>", 3, 20, b"cd"), ("<b>", "response", 2, "u", None, None, None, 1, None, b"x"), ("<b:2>", "continuation", None, None, None, None, "<b>", 2, 9, b"y"), ("<c>", "response", 3, "u", "sha256:0", None, None, None, None, b"H\r\n\r\nbody")]
    got = warc.payloads(warc.joined_segments(spark.createDataFrame(rows, schema)))
    assert {x.record_id: x.status for x in got.collect()} == {"<a>": "segments missing", "<b>": "wrong length", "<c>": "wrong digest"}


def gzip_of(*bodies):
    import gzip

    return b"".join(gzip.compress(b) for b in bodies)


def test_archives_of_many_members_and_damaged_ones(spark, tmp_path):
    records = [warc.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{i}>")], b"HTTP/1.1 200 OK\r\n\r\nbody %d" % i) + b"\n" for i in range(4)]
    (tmp_path / "members.warc.gz").write_bytes(gzip_of(*records))
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "cut.warc.gz").write_bytes(gzip_of(*records[:2]) + gzip_of(records[2])[:-20])
    (tmp_path / "short.warc.gz").write_bytes(gzip_of(records[0] + records[1][:-9]))
    (tmp_path / "other.warc.gz").write_bytes(gzip_of(b"<html>"))
    (tmp_path / "empty.warc.gz").write_bytes(gzip_of(b""))
    got = warc.read_records(spark, str(tmp_path))
    rows = [(x.record_id.rsplit("/")[-1], x.kind) for x in got.collect()]
    assert sorted(r for r, k in rows if k == "response") == sorted(["<0>", "<1>", "<2>", "<3>"] * 2 + ["<0>", "<1>"] + ["<0>"])
    assert sorted(r for r, k in rows if k == "damaged") == ["cut.warc.gz", "other.warc.gz", "short.warc.gz"]
    states = [x.status for x in warc.payloads(warc.joined_segments(got)).collect()]
    assert sorted(states) == ["damaged archive"] * 3 + ["ok"] * 11


def test_a_large_record_of_many_segments(spark):
    page = "<p>" + "0123456789abcdef" * (1 << 18)  # 4 MB in some 500 segments
    got = warc.round_trip(spark.createDataFrame([(1, "u", page), (2, "u", page)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [(x.payload_bytes, x.record_type, x.status) for x in got] == [(len(page), "response", "ok"), (len(page), "revisit", "ok")]
