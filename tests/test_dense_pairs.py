"""Near vectors by blocks: the same pairs as by brute force, and how many pairs of blocks never meet."""

import functools

import numpy as np
import pytest

from kinfold.operators import dense


def table(spark, rows):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in enumerate(rows)], "id long, vec array<double>").repartition(5)


def pairs_of(rows, threshold):
    dots = rows @ rows.T
    return {(int(i), int(j)) for i, j in zip(*np.nonzero(dots >= threshold))}, dots


@pytest.mark.parametrize("seed, threshold", [(1, 0.6), (2, 0.2), (3, 0.95), (4, 0.0), (5, -0.4)])
def test_pairs_equal_brute_force(spark, monkeypatch, seed, threshold):
    monkeypatch.setattr(dense, "BLOCK", 25)
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(160, 6)) + 3 * rng.normal(size=(8, 6))[rng.integers(0, 8, 160)]
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    rows[10:14] = rows[9]  # repeated vectors
    rows[20:23] = 0  # an encoder's nothing
    rows[30] *= 1.7  # not of unit length
    rows[31] *= 0.2
    want, dots = pairs_of(rows, threshold)
    sure = lambda i, j: abs(dots[i, j] - threshold) > 1e-12
    found = dense.dense_edges(table(spark, rows), threshold).collect()
    got = {(r["i"], r["j"]) for r in found}
    assert len(got) == len(found)
    assert {p for p in got ^ want if sure(*p)} == set()
    assert all(abs(r["cos"] - dots[r["i"], r["j"]]) < 1e-9 for r in found)


def skipped(spark, rows, threshold):
    """The share of the pairs of blocks that never meet."""
    dealt, pairs = dense.blocks_of(table(spark, rows), threshold)
    n = dealt.select("b").distinct().count()
    assert max(r["count"] for r in dealt.groupBy("b").count().collect()) <= dense.BLOCK
    return 1 - pairs.count() / (n * (n + 1) / 2)


def test_blocks_of_clusters_hardly_meet(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 32)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 16))
    rows = centres[rng.integers(0, 20, 1500)] + 0.15 * rng.normal(size=(1500, 16))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    assert skipped(spark, rows, 0.75) > 0.8
    want, _ = pairs_of(rows, 0.75)
    assert {(r["i"], r["j"]) for r in dense.dense_edges(table(spark, rows), 0.75).collect()} == want


def test_one_cluster_with_most_rows_is_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 32)
    rng = np.random.default_rng(8)
    rows = np.concatenate([np.eye(1, 8) + 0.3 * rng.normal(size=(600, 8)), rng.normal(size=(100, 8))])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    assert skipped(spark, rows, 0.9) > 0.2
    assert {(r["i"], r["j"]) for r in dense.dense_edges(table(spark, rows), 0.9).collect()} == pairs_of(rows, 0.9)[0]


def test_random_directions_still_give_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 50)
    rng = np.random.default_rng(9)
    rows = rng.normal(size=(300, 32))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    assert {(r["i"], r["j"]) for r in dense.dense_edges(table(spark, rows), 0.3).collect()} == pairs_of(rows, 0.3)[0]


def test_no_vectors_and_few(spark):
    assert dense.dense_edges(table(spark, np.zeros((0, 3))), 0.5).collect() == []
    assert [tuple(r) for r in dense.dense_edges(table(spark, np.eye(1, 3)), 0.5).collect()] == [(0, 0, 1.0)]


@pytest.fixture
def clustered(monkeypatch):
    for name, value in (("BLOCK", 16), ("GRID", 3), ("FIRST", 8)):
        monkeypatch.setattr(dense, name, value)
    rng = np.random.default_rng(11)
    rows = rng.normal(size=(200, 8)) + 2 * rng.normal(size=(9, 8))[rng.integers(0, 9, 200)]
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    rows[10:24] = rows[9]  # repeated vectors
    rows[30:33] = 0
    rows[40:44] *= 0.8  # reach others, but not themselves
    return rows


def test_degrees_and_communities_without_pairs(spark, clustered):
    near, t = pairs_of(clustered, 0.75)[0], 0.75
    deg = {i: sum(p == i for p, _ in near) for i, _ in near}
    order = sorted(deg, key=lambda i: (-deg[i], i))
    first = {j: next(i for i in order if (i, j) in near) for j in deg}
    seeds = []
    for i in order:
        if not any((i, s) in near for s in seeds):
            seeds.append(i)
    apart = {j: next((i for i in seeds if (i, j) in near), None) for j in deg}
    vectors = table(spark, clustered)
    assert {r["i"]: r["deg"] for r in dense.degrees(dense.deal(vectors, t)).collect()} == deg
    found = dense.communities(vectors, t).collect()
    assert {r["member"]: (r["seed"], r["deg"]) for r in found} == {j: (i, deg[i]) for j, i in first.items()}
    found = dense.communities_mis(vectors, t).collect()
    assert {r["member"]: (r["seed"], r["deg"]) for r in found} == {j: (i, deg[i]) for j, i in apart.items() if i is not None}


def test_best_pairs_with_ties(spark, clustered):
    product = lambda x, y: functools.reduce(lambda total, c: total + c, (x * y).tolist(), 0.0)  # noqa: E731  term by term, as SQL
    pairs = [(product(clustered[i], clustered[j]), i, j) for i in range(200) for j in range(i + 1, 200)]
    want = sorted((p for p in pairs if 0.5 <= p[0] < 0.7), reverse=True)[:30]
    assert [(r["cos"], r["i"], r["j"]) for r in dense.best_pairs(table(spark, clustered), 0.5, 0.7, 30).collect()] == want


def test_a_vector_is_sent_to_few_tasks_however_many_there_are(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 10)
    monkeypatch.setattr(dense, "GRID", 3)
    rng = np.random.default_rng(12)
    for n in (200, 600):  # of random directions no block is left out
        dealt = dense.deal(table(spark, rng.normal(size=(n, 8))), 0.01)
        count = lambda batches: (dense._batch(n=np.array([sum(b.num_rows - b.column("vec").null_count for b in batches)])) for _ in range(1))
        assert dealt.met(count, "n long").agg({"n": "sum"}).first()[0] <= 4 * n


def test_a_null_vector_takes_no_part(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 0.0])], "id long, vec array<double>")
    assert sorted(tuple(r)[:2] for r in dense.dense_edges(rows, 0.5).collect()) == [(1, 1), (1, 3), (3, 1), (3, 3)]


def test_groups_are_bounded_by_their_bytes(spark, monkeypatch):
    """Short vectors make few groups however many there are; long ones make as many as it takes."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(dense, "GRID", 2)
    turn = lambda i: F.array(F.cos(i), F.sin(i))
    dealt = dense.deal(spark.range(140_000).select("id", turn(F.col("id") * 0.37).alias("vec")), 0.9999)
    assert dealt.span == 70_000  # two groups
    monkeypatch.setattr(dense, "BLOCK", 20)
    monkeypatch.setattr(dense, "GROUP_BYTES", 8 * 16 * 50)
    assert dense.deal(table(spark, np.eye(1, 16).repeat(400, axis=0)), 0.5).span == 50


def test_centres_are_sent_to_few_tasks_however_many_cells_there_are(spark, monkeypatch):
    """No more rows meet than GRID + 1 for each block, though nearly all pairs of cells are near."""
    monkeypatch.setattr(dense, "GRID", 3)
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(60, 4))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    rows = [(i, i, c.tolist(), 1.0, 1.0) for i, c in enumerate(centres)]
    blocks = spark.createDataFrame(rows, "cell long, b long, centre array<double>, radius double, norm double")
    found = dense._block_pairs(np.ones((60, 60), bool), blocks, 0.5)
    got = [(r["bi"], r["bj"]) for r in found.collect()]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    want = dense._reach(centres, np.ones(60), np.ones(60), centres, np.ones(60), np.ones(60), 0.5)
    assert len(got) == len(set(got)) and set(got) == {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(want)))}
    assert "Join" not in plan and "sequence" in plan
