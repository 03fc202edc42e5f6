"""The corpus pipeline: documents in, packed training batches out. Counted as part of phasegrid.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.llm.common import scratch, table
from phasegrid.llm.minhash import one_of_each
from phasegrid.llm.packing import pack
from phasegrid.llm.suffix_dedup import without_repeats
from phasegrid.llm.toxicity import without_toxic
from phasegrid.llm.weak_labels import only_good

#: Bytes of a repeated passage: those of about 50 short words.
PASSAGE = 240


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose text scores below 0.7 for toxicity; the network learns from `labels`.

    Null and empty texts score as one empty window; ties at 0.7 go; repeated rows are judged alike, each on its own; without labels every
    score is 0.5 and all stay; an empty table stays empty; further columns, whatever their names, come back as they are.
    """
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the scorer trained on weak labels takes for good (score 0.5 or more).

    Null and empty texts and those without words score 0 and go; repeated rows are judged alike; an empty table stays empty; further
    columns, whatever their names, come back as they are.
    """
    return only_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies (five-word shingles, similarity 0.8 or more): that with the least doc_id.

    Null, empty and wordless texts are linked with nothing and all stay; of rows with one doc_id and one text one stays; rows with one doc_id
    and other texts are documents of their own; null ids come last; an empty table stays empty; further columns come back as they are.
    """
    return one_of_each(docs, k=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its text without passages of PASSAGE bytes or more that start elsewhere too, cut at whole characters.

    All occurrences go. Null texts stay null, empty ones empty, and a text may become empty; repeated rows are copies of each other;
    n_chars is counted anew (null for null); an empty table stays empty; further columns, whatever their names, come back as they are.
    """
    return without_repeats(docs, PASSAGE).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in batches of length buckets: see pack().

    Null and empty texts are one piece of no tokens; repeated rows are packed each; an empty table gives no rows.
    """
    return pack(docs)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("packing", packing)]

#: Trained models decide here, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each stage keeps is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(path := scratch(spark, name))
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
