"""Exact medians of groups over and under what a task may hold."""

import random
import statistics

import pytest

from kinfold.operators import medians as M


def plain(rows):
    groups = {}
    for *key, v in rows:
        if v is not None and v == v and abs(v) != float("inf"):
            groups.setdefault(tuple(key), []).append(v)
    return {k: statistics.median(v) for k, v in groups.items()}


@pytest.mark.parametrize("few", [3, 40, 10_000])
def test_medians_of_skewed_groups(spark, monkeypatch, few):
    monkeypatch.setattr(M, "FEW", few)
    monkeypatch.setattr(M, "CELLS", 7)
    rng = random.Random(few)
    rows = [("most", 1, rng.lognormvariate(3, 4)) for _ in range(901)]
    rows += [("one value", None, 5.0)] * 100 + [(None, 2, float(i % 2)) for i in range(100)] + [("two", 1, -1.5), ("two", 1, 2.5), ("one", 1, 7.0)]
    rows += [("wide", 1, v) for v in [-1.7e308, 1.7e308, 0.0, 1e-300, -1e-300, 5e-324] * 20]
    rows += [("most", 1, None), ("most", 1, float("nan")), ("none", 1, None), ("inf", 1, float("inf"))]
    got = M.medians(spark.createDataFrame(rows, "a string, b long, v double").repartition(6), ["a", "b"], "v", "mid").collect()
    want = plain(rows)
    assert len(got) == len(want)
    for r in got:
        assert r["mid"] == pytest.approx(want[r["a"], r["b"]], rel=1e-12, abs=0)


def test_no_rows(spark):
    assert M.medians(spark.createDataFrame([], "a string, v double"), ["a"], "v", "mid").collect() == []
