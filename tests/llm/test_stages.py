"""Filters that keep whole rows: no loss, no clash of names, nulls and empties."""

from phasegrid.llm.minhash import near_duplicates, one_of_each
from phasegrid.llm.suffix_dedup import without_repeats

TEXT = "alpha beta gamma delta epsilon zeta eta theta"
ROWS = [(1, TEXT, "a"), (1, "one two three four five six seven", "b"), (2, TEXT, "c"), (2, TEXT, "d"), (3, None, "e"), (3, None, "f"), (4, "", "g"), (None, TEXT, "h"), (None, "un deux trois quatre cinq six", "i")]
NAMES = "doc_id long, text string, _node string"


def test_one_row_of_each_component_and_no_other_text_lost(spark):
    got = one_of_each(spark.createDataFrame(ROWS, NAMES))
    assert got.columns == ["doc_id", "text", "_node"]
    kept = sorted(x[2] for x in got.collect())
    assert kept == ["a", "b", "e", "f", "g", "i"]


def test_columns_of_any_name_come_back(spark):
    extra = ["_id", "_th", "_node", "_once", "_text", "_spans", "_salt", "nid", "key", "spans"]
    long = "x y " * 150
    texts = [(1, long + "tail"), (2, "some words that stay as they are here"), (3, None)]
    docs = spark.createDataFrame([(i, t, *(10 * i + k for k in range(len(extra)))) for i, t in texts], "doc_id long, text string, " + ", ".join(f"`{c}` long" for c in extra))
    want = [(i, *(10 * i + k for k in range(len(extra)))) for i, _ in texts]
    assert sorted((x[0], *x[2:]) for x in one_of_each(docs).collect()) == want
    got = without_repeats(docs, 240).collect()
    assert sorted((x[0], *x[2:]) for x in got) == want
    got = {x[0]: x.text for x in got}
    assert got[3] is None and got[1].endswith("tail") and len(got[1]) < 60


def test_empty_tables(spark):
    empty = spark.createDataFrame([], NAMES)
    assert one_of_each(empty).collect() == [] and without_repeats(empty, 240).collect() == []


def thue_morse(n, a="a", b="b"):
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join(b if x else a for x in bits)


def test_texts_of_regular_structure_are_told_apart(spark):
    docs = spark.createDataFrame([(1, thue_morse(1024)), (2, thue_morse(1024, "b", "a"))], "doc_id long, text string")
    assert [x.component_id for x in near_duplicates(docs, k=2).orderBy("doc_id").collect()] == [1, 2]


def test_small_sets_lose_no_link(spark):
    import random

    from test_minhash import brute

    r, rows = random.Random(4), []
    for g in range(60):
        base = [f"w{g}_{i}" for i in range(r.randint(4, 16))]
        for _ in range(4):
            own = list(base)
            for _ in range(r.randint(0, 2)):
                own.insert(r.randrange(len(own) + 1), f"x{r.random()}") if r.random() < 0.5 else own.pop(r.randrange(len(own)))
            rows.append((len(rows), " ".join(own)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=1).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == brute(rows, 1)
