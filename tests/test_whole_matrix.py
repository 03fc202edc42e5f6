"""Co-clustering gives the whole matrix of the registered table, dealt over tasks by both of its sides."""

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from phasegrid.operators import validity
from phasegrid.plans import catalogue


def test_coclustering_of_every_vector_with_every_other(spark, tmp_path):
    ids, x = np.arange(1, 71), np.random.default_rng(2).standard_normal((70, 64)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": ids, "embedding": pa.array(x.tolist(), pa.list_(pa.float32())), "label": np.zeros(70, np.int32)}), tmp_path / "embeddings.parquet")
    got = {(r.id_a, r.id_b): (r.together, r.n_runs) for r in catalogue.QUERIES["coclustering_share"](spark, str(tmp_path)).collect()}
    assert got.keys() == set(itertools.product(ids.tolist(), repeat=2))
    assert all(got[i, i] == (1.0, 16) for i in ids.tolist()) and all(got[a, b] == got[b, a] for a, b in got)
    for a, b in ((1, 2), (3, 33), (50, 51)):
        runs = [r for r in range(20) if (a + r) % 5 and (b + r) % 5]
        of = lambda i, r: (x[i - 1, r] > 0, x[i - 1, r + 30] > 0)
        assert got[a, b] == (round(np.mean([of(a, r) == of(b, r) for r in runs]), 6), len(runs))


def test_a_whole_matrix_is_no_single_task(spark):
    rows = spark.range(600).select(F.col("id"), F.lit(0).alias("run"), (F.col("id") % 3).alias("cluster"))
    out = validity.coclustering(rows, wanted=F.lit(True))
    assert out.rdd.getNumPartitions() >= 3 and out.count() == 600 * 600
