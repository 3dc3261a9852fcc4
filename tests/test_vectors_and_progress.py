"""Vectors kept by text, and reports while a run goes on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.operators import progress
from kinfold.operators.eventlog import Folder
from kinfold.operators.vectors import Vectors


def test_only_new_texts_are_encoded(spark, tmp_path, monkeypatch):
    calls = tmp_path / "calls"

    def encode(some):
        with calls.open("a") as f:
            f.writelines(f"{t}\n" for t in some)
        return np.array([[len(t), 1.0] for t in some])

    def run(rows, version="one"):
        frame = spark.createDataFrame(rows, "id long, text string").repartition(3)
        got = {r["id"]: r["vec"] for r in Vectors(spark, f"file://{tmp_path}/store", version).encoded(frame, encode).collect()}
        asked = sorted(calls.read_text().split()) if calls.exists() else []
        calls.write_text("")
        for i, text in rows:
            assert (i in got) == (text is not None)
            assert text is None or np.allclose(got[i], np.array([len(text), 1.0]) / np.hypot(len(text), 1))
        return asked

    rows = [(1, "aa"), (2, "bbb"), (3, "aa"), (4, None)]
    with monkeypatch.context() as m:
        m.setattr(Folder, "publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run(rows)  # a crash before what was encoded is published
    calls.write_text("")
    assert run(rows) == ["aa", "bbb"] and run(rows) == []
    assert run([(9, "bbb"), (8, "cccc")]) == ["cccc"] and run([*rows, (8, "cccc")]) == []
    assert run(rows, "two") == ["aa", "bbb"]
    assert run([]) == []


def test_reports_grow_to_one(spark):
    told = []
    rows = spark.range(0, 4_000_000, 1, 16).withColumn("k", F.col("id") % 1000)
    with progress.reported(spark, lambda share, step: told.append((share, step)), steps=2) as begin:
        begin("first")
        rows.groupBy("k").agg(F.sum(F.sqrt("id"))).collect()
        begin("second")
        rows.groupBy(F.xxhash64("k")).agg(F.max("id")).collect()
    shares = [s for s, _ in told]
    assert shares == sorted(set(shares)) and shares[0] == 0.0 and shares[-1] == 1.0 and any(0 < s < 1 for s in shares)
    assert [n for n in dict.fromkeys(n for _, n in told) if n] == ["first", "second"]


def test_an_error_is_passed_on(spark):
    told = []
    with pytest.raises(ValueError):
        with progress.reported(spark, lambda share, step: told.append(share)) as begin:
            begin("only")
            raise ValueError
    assert 1.0 not in told and spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
