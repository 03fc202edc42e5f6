import os

import numpy as np
import pytest

from phasegrid.sources import formats, recordings


def test_exports_in_ranges_equal_the_text_reader(spark, tmp_path):
    formats.register(spark)
    lines = ["﻿some note", "sec\tCH1\tCH2", "\tECG one\tSKT A", *(f"{i / 10}\t{i * 1.5}\t{'-' if i % 7 == 0 else 30 + i}" for i in range(500)), "broken line", "x\t1\t2", "51.0\t1\t2"]
    (tmp_path / "7_kim_ab.txt").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "8_lee_cd.txt").write_text("no header\n1\t2\n")
    (tmp_path / "9_no_ef.txt").write_text("sec\tCH1\n\tECG\n")
    (tmp_path / "note.md").write_text("sec\n")
    shape = ["subject", "condition", "channel", "description", "t_sec", "value"]
    want = sorted(map(tuple, recordings.read_exports(spark, str(tmp_path)).where("status = 'ok'").select(*shape).collect()), key=str)
    for size in (37, 1000, 1 << 20):
        df = spark.read.format("signal_export").option("range_bytes", size).load(str(tmp_path))
        got = sorted(map(tuple, df.where("status = 'ok'").select(*shape).collect()), key=str)
        assert len(got) == 2 * 501 and got == want
    assert {r.subject: r.status for r in df.where("status <> 'ok'").collect()} == {"8": "no header line", "9": "no samples"}
    assert spark.read.format("signal_export").load(f"{tmp_path}/7_kim_ab.txt").count() == 2 * 501


def test_one_array_a_signal_and_back(spark, tmp_path):
    rows = [(s, c, float(t), None if t == 3 else s + t / 10) for s in (1, 2) for c in ("AB", "CD") for t in range(50)]
    df = spark.createDataFrame(rows, "subject int, condition string, t_sec double, value double").repartition(6)
    formats.write_arrays(df, f"{tmp_path}/a", ["subject", "condition"], "t_sec", suffix="st")
    assert sorted(os.listdir(tmp_path / "a")) == [f"{s}_{c}_st.npy" for s in (1, 2) for c in ("AB", "CD")]
    x = np.load(tmp_path / "a" / "2_CD_st.npy")
    assert len(x) == 50 and np.isnan(x[3]) and x[10] == 3.0
    for size in (7, 1000):
        back = spark.read.format("signal_arrays").option("range_items", size).load(f"{tmp_path}/a").where("name = '2_CD_st'").orderBy("i").collect()
        assert [r.i for r in back] == list(range(50)) and np.allclose([r.value for r in back], x, equal_nan=True)
    formats.write_arrays(df.where("subject = 1"), f"{tmp_path}/a", ["subject"], "t_sec", mode="overwrite")
    assert os.listdir(tmp_path / "a") == ["1.npy"] and len(np.load(tmp_path / "a" / "1.npy")) == 100
    with pytest.raises(Exception, match="spread over|no name"):
        df.selectExpr("concat('s', subject) as name", "value").sort("value").coalesce(1).write.format("signal_arrays").mode("append").save(f"{tmp_path}/b")
    assert not [f for f in os.listdir(tmp_path / "b") if f.endswith(".npy")] if os.path.isdir(tmp_path / "b") else True


def test_two_runs_in_one_second_give_the_later(spark, tmp_path):
    folder = str(tmp_path / "runs")
    for i in range(12):
        recordings.log_run(spark, folder, f"run/{11 - i}", {}, {}, parent="p" if i < 5 else None, created_at="2024-01-01T00:00:00")
        assert recordings.latest_run(spark, folder) == f"run/{11 - i}"
    assert recordings.latest_run(spark, folder, "p") == "run/7"
    assert len(os.listdir(f"{folder}/_latest/all")) <= 2 * 8 and recordings.point_to(spark, folder, "again") == 13 and recordings.latest_run(spark, folder) == "again"
