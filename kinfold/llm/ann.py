"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors is joined to its nearest neighbours; that
graph is cut into parts of nearly equal size with few edges between them, and
a small classifier learns which parts hold a vector's neighbours.  The
classifier then places every vector in its most probable part and sends every
query to its most probable parts, where all vectors are compared exactly.

The number of parts grows with the rows, as far as the sample can tell parts
apart.  A query visits at least as many parts as queries of the sample that
had no say in the fit need to find ``RECALL`` of their true neighbours, and
goes on to less probable parts until those it visits hold ``k`` candidates
other than itself, or to all of them: every query gets ``k`` neighbours, or
all there are.

Vectors are dealt to ``LANES`` lanes by their id, so each holds a share of
every part, and queries to groups of about ``QUERIES``.  Each lane meets each
group in a task that holds the queries and reads the vectors part by part,
``CHUNK`` at a time, keeping the best ``k`` of each query.  So a query gives
``k`` rows for each lane, however many parts there are, and a task holds no
more of the vectors than a chunk, whatever share of the rows one part holds.
Up to ``QUERIES`` queries a vector is sent once; beyond, once for each group.

Vectors that are null, zero, of another length than most of the sample, or
that hold a null or non-finite component take no part, and neither do rows
with a null id.  Rows that repeat an id are one candidate, with their best
score; a query's own id is never its neighbour.  Ties in score go to the
smaller id.  Without two usable vectors the answer is empty.  Other columns
are left out.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, settle

#: Vectors of the sample: so many, or a share of a larger table up to the second.  One in HELD_OUT does not fit.
SAMPLE, MOST_SAMPLE, SAMPLE_SHARE, HELD_OUT = 4096, 16_384, 1 / 64, 8
#: Parts of a small table, rows of a part beyond that, sample rows that a part takes at least; neighbours of a vector in the graph.
PARTS, PART_ROWS, PART_SAMPLE, DEGREE = 16, 2048, 16, 10
RECALL, SLACK = 0.95, 0.05
CHUNK, BLOCK = 2048, 2048
#: Tasks that share the vectors out, queries of a task, and scores summed at once.
LANES, QUERIES, PIECE = 12, 65_536, 65_536
STEPS, BATCH = 300, 4096


@dataclass(frozen=True)
class Router:
    """A classifier of vectors to parts, and how many parts a query visits."""

    weights: np.ndarray
    bias: np.ndarray
    visits: int

    def order(self, x: np.ndarray) -> np.ndarray:
        """The parts of each vector, most probable first."""
        return np.argsort(-(x @ self.weights + self.bias), axis=1, kind="stable")

    def home(self, x: np.ndarray) -> np.ndarray:
        """The part that holds each vector."""
        return np.argmax(x @ self.weights + self.bias, axis=1)

    def route(self, x: np.ndarray, held: np.ndarray, least: int) -> list[list[int]]:
        """The parts that each vector visits: ``visits``, and more until they hold ``least`` candidates or are all."""
        order = self.order(x)
        enough = (np.cumsum(held[order], axis=1) < least).sum(axis=1) + 1
        return [row[: max(self.visits, n)] for row, n in zip(order.tolist(), enough.tolist())]


def neighbour_graph(x: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """The places of each vector's neighbours of largest inner product."""
    near = np.empty((len(x), min(degree, len(x) - 1)), np.int64)
    for i in range(0, len(x), 512):
        dots = x[i : i + 512] @ x.T
        dots[np.arange(len(dots)), np.arange(i, i + len(dots))] = -np.inf
        near[i : i + 512] = np.argpartition(-dots, near.shape[1] - 1, axis=1)[:, : near.shape[1]] if near.shape[1] else 0
    return near


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Labels of a partition with few cut edges; no part exceeds its share by more than SLACK."""
    n = len(x)
    cap = int(np.ceil(n / parts * (1 + SLACK)))
    rng = np.random.default_rng(7)
    centres = x[rng.choice(n, parts, replace=False)]
    for _ in range(8):  # a start for the refinement: balanced nearest centres
        fit = x @ centres.T
        label, room = np.full(n, -1), np.full(parts, cap)
        wish = np.argsort(-fit, axis=1)
        for i in np.argsort(-(fit.max(axis=1) - fit.mean(axis=1))):
            label[i] = next(p for p in wish[i] if room[p] > 0)
            room[label[i]] -= 1
        centres = np.stack([x[label == p].mean(axis=0) if (label == p).any() else centres[p] for p in range(parts)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    back: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(near.tolist()):
        for j in row:
            back[j].append(i)
    linked = [np.array([*row, *back[i]], np.int64) for i, row in enumerate(near.tolist())]
    size = np.bincount(label, minlength=parts)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n):
            gain = np.bincount(label[linked[i]], minlength=parts)
            best = int(np.argmax(np.where(size < cap, gain, -1)))
            if gain[best] > gain[label[i]]:
                size[label[i]] -= 1
                size[best] += 1
                label[i] = best
                moved += 1
        if not moved:
            break
    return label


def part_count(rows: int, sample: int) -> int:
    """The number of parts of a table."""
    return max(1, min(max(PARTS, rows // PART_ROWS), sample // PART_SAMPLE))


def fit(x: np.ndarray, k: int, parts: int, recall: float = RECALL) -> Router:
    """The router of a sample of vectors (rows), in no particular order."""
    asked, x = x[::HELD_OUT], np.delete(x, np.s_[::HELD_OUT], axis=0)
    if parts == 1 or len(x) < 2 * parts:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), 1)
    near = neighbour_graph(x)
    label = balanced_parts(x, near, parts)
    want = np.zeros((len(x), parts))
    want[np.arange(len(x)), label] = 1
    np.add.at(want, (np.arange(len(x))[:, None], label[near]), 1)
    want /= want.sum(axis=1, keepdims=True)
    scale = 1 / max(np.sqrt((x * x).sum(axis=1)).mean(), 1e-12)
    theta = np.zeros((x.shape[1] + 1, parts))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    xs, rng = np.hstack([x * scale, np.ones((len(x), 1))]), np.random.default_rng(11)
    for step in range(1, STEPS + 1):  # softmax regression on the parts of a vector and its neighbours, by Adam
        some = rng.choice(len(x), BATCH, replace=False) if len(x) > BATCH else slice(None)
        z = xs[some] @ theta
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = xs[some].T @ (p - want[some]) / len(z) + 1e-5 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    router = Router(theta[:-1] * scale, theta[-1], parts)
    home, dots = router.home(x), asked @ x.T
    kk = min(k, len(x))
    true = np.argpartition(-dots, kk - 1, axis=1)[:, :kk]
    turn = np.argsort(router.order(asked), axis=1)  # of each part, when a query comes to it
    late = np.take_along_axis(turn, home[true], axis=1)
    found = [(late < visits).mean() for visits in range(1, parts + 1)]
    return Router(router.weights, router.bias, next((i + 1 for i, r in enumerate(found) if r >= recall), parts))


def usable(rows: DataFrame) -> DataFrame:
    """The rows of vec_id, embedding, asks that take part, with ``vec`` in double precision."""
    finite = F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    good = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(finite & F.exists("embedding", lambda c: c != 0))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"), F.coalesce("asks", F.lit(False)).alias("asks"))


def best_of(i: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int, repeats: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best rows for each query place ``i``, in order; an id, if any repeats, counts once, with its best score."""
    if repeats:
        order = np.lexsort((-scores, ids, i))  # the best row of each id
        i, ids, scores = i[order], ids[order], scores[order]
        first = np.r_[True, (i[1:] != i[:-1]) | (ids[1:] != ids[:-1])] if len(i) else np.zeros(0, bool)
        i, ids, scores = i[first], ids[first], scores[first]
    order = np.lexsort((ids, -scores, i))
    i, ids, scores = i[order], ids[order], scores[order]
    best = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[best], ids[best], scores[best]


def nearest(asks: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, and ids and scores of rows of other ids, among them all of the ``k`` best that reach the query's bar; a row's score is summed on its own."""
    dots = asks @ x.T
    dots[own[:, None] == ids[None, :]] = -np.inf
    least = _loose(bar)
    rows = k * np.unique(ids, return_counts=True)[1].max()  # hold k ids, however they repeat
    if rows < len(ids) and np.count_nonzero(dots >= least[:, None]) > k * len(asks):
        least = np.maximum(least, _loose(-np.partition(-dots, rows - 1, axis=1)[:, rows - 1]))
    i, j = np.nonzero((dots >= least[:, None]) & (dots > -np.inf))
    pieces = [(x[j[a : a + PIECE]] * asks[i[a : a + PIECE]]).sum(axis=1) for a in range(0, len(i), PIECE)]
    return i, ids[j], np.concatenate(pieces) if pieces else np.empty(0)


def _loose(scores: np.ndarray) -> np.ndarray:
    """Scores that a product may be rounded to where the exact one is at least ``scores``."""
    return np.where(np.isfinite(scores), scores - 1e-9 * np.maximum(1.0, np.abs(scores)), -np.inf)


class Asking:
    """Queries of a task, the parts each visits, the best rows found so far, and found ones that wait to be looked through."""

    def __init__(self, own: np.ndarray, vec: np.ndarray, visits: np.ndarray, k: int, repeats: bool):
        self.own, self.vec, self.visits, self.k, self.repeats = own, vec, visits, k, repeats
        self.ids, self.scores = np.zeros((len(own), k), np.int64), np.full((len(own), k), -np.inf)
        self.wait, self.waiting = [], 0

    def meet(self, part: int, ids: np.ndarray, x: np.ndarray) -> None:
        """Rows of a part against the queries that visit it."""
        visitors = np.flatnonzero(self.visits[:, part])
        for a in range(0, len(visitors), BLOCK):
            at = visitors[a : a + BLOCK]
            i, found, scores = nearest(self.vec[at], self.own[at], x, ids, self.k, self.scores[at, -1])
            self.wait.append((at[i], found, scores))
            self.waiting += len(i)
            if self.waiting > self.scores.size:
                self.look_through()

    def look_through(self) -> None:
        if not self.waiting:
            return
        i, found, scores = (np.concatenate(c) for c in zip(*self.wait))
        self.wait, self.waiting = [], 0
        had = np.unique(i)
        old, rank = np.nonzero(self.scores[had] > -np.inf)
        i, found, scores = np.r_[i, had[old]], np.r_[found, self.ids[had[old], rank]], np.r_[scores, self.scores[had[old], rank]]
        i, found, scores = best_of(i, found, scores, self.k, self.repeats)
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        self.ids[i, rank], self.scores[i, rank] = found, scores

    def best(self) -> pa.RecordBatch:
        self.look_through()
        i, rank = np.nonzero(self.scores > -np.inf)
        return pa.RecordBatch.from_pydict({"query_id": pa.array(self.own[i]), "vec_id": pa.array(self.ids[i, rank]), "score": pa.array(self.scores[i, rank])})


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("vec").flatten().to_numpy().reshape(-1, dim)


def compared(index: DataFrame, asking: DataFrame, dim: int, parts: int, k: int, repeats: bool) -> DataFrame:
    """query_id, vec_id, score: of each query (vec_id, vec, visits: a bit for each part) the ``k`` best rows (vec_id, vec, p) of each lane; ``repeats``: ids do."""
    groups = max(1, -(-asking.count() // QUERIES))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    stored = index.select(F.pmod(F.xxhash64("vec_id"), F.lit(LANES)).cast("int").alias("lane"), each(groups).alias("g"), F.lit(1).alias("side"), "p", "vec_id", "vec")
    queries = asking.select(each(LANES).alias("lane"), F.pmod(F.xxhash64("vec_id", "vec"), F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("side"), F.lit(-1).alias("p"), "vec_id", "vec", "visits")

    def compare(batches):
        """The rows of a lane and a group in a row: the queries first, then vectors by part."""
        key, asked, queue, asks = None, None, [], []

        def drain() -> None:  # vectors of one part
            if queue:
                ids, x = (np.concatenate(c) for c in zip(*queue))
                for a in range(0, len(ids), CHUNK):
                    asked.meet(key[3], ids[a : a + CHUNK], x[a : a + CHUNK])
                queue.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            of = np.stack([batch.column(c).to_numpy() for c in ("lane", "g", "side", "p")])
            ids, x = batch.column("vec_id").to_numpy(), _matrix(batch, dim)
            turns = np.flatnonzero((np.diff(of) != 0).any(axis=0)) + 1
            for lo, hi in zip(np.r_[0, turns], np.r_[turns, len(ids)]):
                now = tuple(of[:, lo].tolist())
                if key != now:
                    drain()
                    if asked and key[:2] != now[:2]:
                        yield asked.best()
                        asked = None
                    if key and key[:2] != now[:2]:
                        asks.clear()
                    key = now
                if now[2] == 0:
                    bits = np.frombuffer(b"".join(batch.column("visits").slice(lo, hi - lo).to_pylist()), np.uint8).reshape(hi - lo, -1)
                    asks.append((ids[lo:hi], x[lo:hi], np.unpackbits(bits, axis=1, count=parts).astype(bool)))
                    continue
                if asks:
                    asked = Asking(*(np.concatenate(c) for c in zip(*asks)), k, repeats)
                    asks.clear()
                if asked:
                    queue.append((ids[lo:hi], x[lo:hi]))
                    if sum(len(q[0]) for q in queue) >= CHUNK:
                        drain()
        drain()
        if asked:
            yield asked.best()

    met = queries.unionByName(stored, allowMissingColumns=True).repartition("lane", "g").sortWithinPartitions("lane", "g", "side", "p")
    return met.mapInArrow(compare, "query_id long, vec_id long, score double")


def search(rows: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", parts: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product found for each query row."""
    spark = rows.sparkSession
    prepare(spark)
    good = usable(rows.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"), is_query.alias("asks")))
    n_rows = rows.count()
    size = int(min(MOST_SAMPLE, max(SAMPLE, n_rows * SAMPLE_SHARE)))
    sample = [r["vec"] for r in good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).collect()]  # of a bounded size
    if len(sample) < 2:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = Counter(map(len, sample)).most_common(1)[0][0]
    fitted = np.array([v for v in sample if len(v) == dim])
    router = fit(fitted, k, parts or part_count(n_rows, len(fitted)))
    n_parts = router.weights.shape[1]

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                home = pa.array(router.home(_matrix(batch, dim)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, home], names=["vec_id", "vec", "asks", "p"])

    index = settle(good.filter(F.size("vec") == dim).mapInArrow(place, "vec_id long, vec array<double>, asks boolean, p int"), "vectors")
    # One row for each part.  An id that stands in several parts counts in one of them.
    distinct = {r["p"]: r["n"] for r in index.groupBy("vec_id").agg(F.min("p").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = np.array([distinct.get(p, 0) for p in range(n_parts)])

    def send(batches):
        for batch in batches:
            if batch.num_rows:
                visits = np.zeros((batch.num_rows, n_parts), bool)
                for of, parts_of in zip(visits, router.route(_matrix(batch, dim), held, k + 1)):
                    of[parts_of] = True
                bits = pa.array([row.tobytes() for row in np.packbits(visits, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vec"), bits], names=["vec_id", "vec", "visits"])

    asking = settle(index.filter("asks").select("vec_id", "vec").mapInArrow(send, "vec_id long, vec array<double>, visits binary"), "routes")
    found = compared(index, asking, dim, n_parts, k, bool(index.count() > held.sum()))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    turn = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(turn)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
