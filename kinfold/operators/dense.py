"""Pairs of near vectors, with blocks of vectors left out by exact bounds.

Vectors are dealt to cells around pivots, and within a cell by their angle to
the pivot to blocks, so that blocks are tight.  A block is known by its centre,
its radius (the widest angle of a vector to the centre) and its longest
vector.  Two vectors of two blocks are at least (angle of the centres - both
radii) apart, so blocks whose bound can't reach the threshold never meet.  The
same bound between cells, of which there are a bounded number, comes first,
so that blocks of far cells aren't even compared.

Pivots come from a bounded sample of the vectors.  They decide only how tight
blocks are, never what is found.

Blocks that follow each other make a group, and each pair of groups meets in
one task, which multiplies only the pairs of blocks that may hold something.
There are ``GRID`` groups, so a vector is sent ``GRID`` times at most however
many there are, until groups are as large as a task may hold (``GROUP_BYTES``).
Pairs number as the square of the vectors, so only ``dense_edges`` gives them;
degrees, communities and best pairs are summed up where blocks meet, and no
pair is written or shuffled for them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stage import settle
from .ranking import ranked

#: Vectors of a block, vectors sampled for pivots for each cell, and the most cells.
BLOCK, SAMPLE, CELLS = 2048, 16, 1024
#: Groups of blocks, and the most bytes of one's vectors in double precision (but for its last block); a task holds two groups.
GRID, GROUP_BYTES = 8, 128 << 20
#: The place of a vector that isn't asked for, and the first so many in order that seeds are sought among.
NOWHERE, FIRST = 1 << 62, 2048
#: Bounds are loosened by so much, so that rounding never loses a pair.
SLACK = 1e-6


def _angles(dots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(dots, -1.0, 1.0))


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=-1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1.0)


def pivots(vectors: DataFrame, cells: int) -> np.ndarray:
    """Centres of a sample of SAMPLE * cells vectors (those whose ids' hashes come first), by a few rounds of spherical means."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * cells).select("vec").collect()
    sample = _unit(np.array([r[0] for r in rows], float))
    sample = np.unique(sample[np.linalg.norm(sample, axis=1) > 0], axis=0)
    if not len(sample):
        return np.zeros((1, 1))
    # Each next pivot is the sample vector furthest from those there are.
    centres, nearest = [sample[0]], sample @ sample[0]
    while len(centres) < min(cells, len(sample)):
        k = int(np.argmin(nearest))
        centres.append(sample[k])
        nearest = np.maximum(nearest, sample @ sample[k])
    centres = np.array(centres)
    for _ in range(4):
        near = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 1e-9, _unit(sums), centres)
    return centres


def blocks_of(vectors: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The vectors with their block (id, vec, b), and the pairs of blocks (bi <= bj) that may hold a pair of the threshold."""
    vectors = vectors.filter("vec IS NOT NULL")
    spark, n = vectors.sparkSession, vectors.count()
    kind = vectors.schema["vec"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"  # single precision is widened where blocks meet
    whole = vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast(kind).alias("vec"))
    if n <= BLOCK:
        return whole.withColumn("b", F.lit(0).cast("long")), spark.range(1).select(F.col("id").alias("bi"), F.col("id").alias("bj"))
    centres = pivots(whole, min(CELLS, 4 * -(-n // BLOCK)))
    shared = spark.sparkContext.broadcast(centres)  # CELLS vectors at most

    def cell(frames):
        for frame in frames:
            rows = np.array(frame["vec"].tolist(), float).reshape(len(frame), -1)
            if not len(rows):
                continue
            norms, of = np.linalg.norm(rows, axis=1), np.zeros((len(rows), 1))
            if rows.shape[1] == shared.value.shape[1]:
                of = _unit(rows) @ shared.value.T
            near = np.argmax(of, axis=1)
            yield pd.DataFrame({"id": frame["id"], "vec": frame["vec"], "cell": near, "angle": _angles(of[np.arange(len(rows)), near]), "norm": norms})

    near = whole.mapInPandas(cell, f"id long, vec {kind}, cell long, angle double, norm double")
    placed = settle(ranked(near, [F.col("cell"), F.col("angle"), F.col("id")], "place"), "dense-order")
    cells = placed.groupBy("cell").agg(F.min("place").alias("first"), F.max("angle").alias("radius"), F.max("norm").alias("norm"))
    blocked = placed.join(F.broadcast(cells.select("cell", "first")), "cell").withColumn("k", F.floor((F.col("place") - F.col("first")) / BLOCK))
    blocked = blocked.select("id", "vec", "cell", (F.col("first") + F.col("k") * BLOCK).alias("b"))
    if threshold <= 0:  # no angle is too wide
        ids = settle(blocked.select("b").distinct(), "dense-blocks")
        return blocked.drop("cell"), _all_pairs(ids)
    blocked = settle(blocked, "dense-blocks")
    found = cells.orderBy("cell").collect()  # a row for each cell
    centre, radius, norm = centres[[r["cell"] for r in found]], np.array([r["radius"] for r in found]), np.array([r["norm"] for r in found])
    number, near = [r["cell"] for r in found], np.zeros((len(centres), len(centres)), bool)  # CELLS squared at most
    near[np.ix_(number, number)] = _reach(centre, radius, norm, centre, radius, norm, threshold)
    return blocked.drop("cell"), settle(_block_pairs(near | near.T, summaries(blocked), threshold), "block-pairs")


def _all_pairs(ids: DataFrame) -> DataFrame:
    """Every pair of blocks, each once: the k-th of them meets those numbered up to k."""
    numbered = settle(ranked(ids, [F.col("b")], "place"), "numbered-blocks")
    meets = numbered.select(F.col("b").alias("bj"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("place"))).alias("place"))
    return meets.join(numbered.select(F.col("b").alias("bi"), "place"), "place").select("bi", "bj")


def _reach(a: np.ndarray, ra: np.ndarray, na: np.ndarray, b: np.ndarray, rb: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether groups with these centres, radii and longest vectors may hold a pair with a product of ``threshold``."""
    least = np.maximum(_angles(a @ b.T) - np.add.outer(ra, rb) - SLACK, 0.0)
    most = np.where(least < np.pi / 2, np.cos(np.minimum(least, np.pi / 2)), 0.0) * np.multiply.outer(na, nb)
    return most >= threshold - SLACK


def summaries(blocked: DataFrame) -> DataFrame:
    """cell, b, centre, radius, norm of each block."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = np.array(frame["vec"].tolist(), float)
        norms, rows = np.linalg.norm(rows, axis=1), _unit(rows)
        centre = _unit(rows.sum(axis=0))
        if not centre.any():
            centre = np.eye(1, len(centre))[0]
        some = norms > 0
        return pd.DataFrame({"cell": [frame["cell"].iloc[0]], "b": [key[0]], "centre": [centre], "radius": [float(_angles(rows[some] @ centre).max(initial=0.0))], "norm": [float(norms.max())]})

    return blocked.groupBy("b").applyInPandas(run, "cell long, b long, centre array<double>, radius double, norm double")


def _block_pairs(near: np.ndarray, blocks: DataFrame, threshold: float) -> DataFrame:
    """bi <= bj of the blocks of near cells that the bound lets through; cells meet in a grid of groups, so a block's centre is sent GRID + 1 times."""
    known = settle(blocks, "block-centres").withColumn("g", F.pmod("cell", F.lit(GRID)))
    each = lambda first, last: F.explode(F.sequence(first, last))
    left = known.select(F.col("g").alias("gi"), each(F.col("g"), F.lit(GRID - 1).cast("long")).alias("gj"), "cell", "b", "centre", "radius", "norm")
    right = known.select(each(F.lit(0).cast("long"), F.col("g")).alias("hi"), F.col("g").alias("hj"), *[F.col(c).alias(f"{c}_") for c in ("cell", "b", "centre", "radius", "norm")])  # names of its own: both sides come from one table

    def meet(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        if len(a) and len(b):
            b = b.rename(columns=lambda c: c[:-1] if c.endswith("_") else c)
            side = lambda f: (np.array(f["centre"].tolist()), f["radius"].to_numpy(), f["norm"].to_numpy())
            other = side(b)
            for k in range(0, len(a), CELLS):
                some = a.iloc[k : k + CELLS]
                x, y = np.nonzero(near[np.ix_(some["cell"], b["cell"])] & _reach(*side(some), *other, threshold))
                bi, bj = some["b"].to_numpy()[x], b["b"].to_numpy()[y]
                once = bi <= bj if key[0] == key[1] else slice(None)
                found.append((np.minimum(bi, bj)[once], np.maximum(bi, bj)[once]))
        bi, bj = map(np.concatenate, zip(*found))
        return pd.DataFrame({"bi": bi, "bj": bj})

    return left.groupBy("gi", "gj").cogroup(right.groupBy("hi", "hj")).applyInPandas(meet, "bi long, bj long")


@dataclass(frozen=True)
class Dealt:
    """Vectors dealt to blocks: rows (id, vec, b, place), the pairs of blocks that may hold a pair, and vectors of a group."""

    rows: DataFrame
    pairs: DataFrame
    span: int
    threshold: float

    def with_rows(self, rows: DataFrame) -> Dealt:
        return replace(self, rows=rows)

    def met(self, work: Callable, schema: str) -> DataFrame:
        """What ``work`` gives of the meetings of each pair of groups, which one task sees in a row."""
        group = lambda b: F.floor(F.col(b) / self.span)
        pairs = self.pairs.select(group("bi").alias("gi"), group("bj").alias("gj"), "bi", "bj")
        sent = lambda side, b: pairs.select("gi", "gj", F.col(b).alias("b"), F.lit(side).alias("side")).distinct().join(self.rows, "b")
        meets = pairs.select("gi", "gj", F.col("bi").alias("b"), F.lit(2).alias("side"), F.col("bj").alias("id"), F.lit(0).cast("long").alias("place"))
        # Blocks of one group stand on one side; vectors come before the pairs of blocks, in which id is the other block.
        own = pairs.filter("gi = gj").select("gi", "gj", F.explode(F.array("bi", "bj")).alias("b"), F.lit(0).alias("side")).distinct().join(self.rows, "b")
        sides = own.unionByName(sent(0, "bi").filter("gi <> gj")).unionByName(sent(1, "bj").filter("gi <> gj"))
        every = sides.unionByName(meets, allowMissingColumns=True).select("gi", "gj", "side", "b", "id", "vec", "place")
        return every.repartition("gi", "gj").sortWithinPartitions("gi", "gj", "side", "b").mapInArrow(work, schema)


@dataclass
class Block:
    """Vectors of a block in a task, by place, and what was found of each."""

    ids: np.ndarray
    vec: np.ndarray
    place: np.ndarray
    asked: int
    found: np.ndarray | None = None


def deal(vectors: DataFrame, threshold: float) -> Dealt:
    dealt, pairs = blocks_of(vectors, threshold)
    n, width = dealt.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    most = max(BLOCK, GROUP_BYTES // (8 * max(1, width or 1)))
    return Dealt(dealt.withColumn("place", F.lit(0).cast("long")), pairs, min(most, max(BLOCK, -(-n // GRID))), threshold)


def _block(parts: list) -> Block:
    ids, vec, place = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((ids, place))
    return Block(ids[order], vec[order], place[order], int((place < NOWHERE).sum()))


def _meetings(batches) -> Iterator[tuple[Block, Block] | list[Block]]:
    """The pairs of blocks that meet, and after those of a pair of groups all blocks of theirs."""
    key, sides = None, ({}, {})

    def whole(blocks: dict, b: int) -> Block | None:
        if isinstance(blocks.get(b), list):
            blocks[b] = _block(blocks[b])
        return blocks.get(b)

    done = lambda: [x for blocks in sides for x in blocks.values() if isinstance(x, Block)]
    for batch in batches:
        if not batch.num_rows:
            continue
        gi, gj, side, b, ids, place = (batch.column(c).to_numpy() for c in ("gi", "gj", "side", "b", "id", "place"))
        turns = np.flatnonzero((np.diff(gi) != 0) | (np.diff(gj) != 0) | (np.diff(side) != 0) | ((np.diff(b) != 0) & (side[1:] < 2))) + 1
        for lo, hi in zip(np.r_[0, turns], np.r_[turns, len(gi)]):
            if key != (gi[lo], gj[lo]):
                if key is not None:
                    yield done()
                key, sides = (gi[lo], gj[lo]), ({}, {})
            if side[lo] < 2:
                vec = batch.column("vec").slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).astype(float)
                sides[side[lo]].setdefault(b[lo], []).append((ids[lo:hi], vec.reshape(hi - lo, len(vec) // (hi - lo)), place[lo:hi]))
                continue
            for bi, bj in zip(b[lo:hi], ids[lo:hi]):
                left, right = whole(sides[0], bi), whole(sides[int(key[0] != key[1])], bj)
                if left is not None and right is not None:  # not all blocks need have rows
                    yield left, right
    if key is not None:
        yield done()


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in columns.items()})


def dense_edges(vectors: DataFrame, threshold: float) -> DataFrame:
    """Pairs i, j with product >= threshold of vectors (id, vec), each with itself and in both orders.

    Pairs are given block by block as they are found, so memory is bounded.
    """

    def work(batches):
        for met in _meetings(batches):
            if isinstance(met, list):
                continue
            a, b = met
            dots = a.vec @ b.vec.T
            p, q = np.nonzero(dots >= threshold)
            i, j, cos = a.ids[p], b.ids[q], dots[p, q]
            yield _batch(i=i, j=j, cos=cos)
            if a is not b:  # the other order
                yield _batch(i=j, j=i, cos=cos)

    return deal(vectors, threshold).met(work, "i long, j long, cos double")


def degrees(dealt: Dealt) -> DataFrame:
    """i, deg: how many vectors each reaches, itself included; those that reach none are left out."""
    threshold = dealt.threshold

    def count(block: Block, more: np.ndarray) -> None:
        block.found = more if block.found is None else block.found + more

    def work(batches):
        for met in _meetings(batches):
            if isinstance(met, list):
                for block in met:
                    yield _batch(i=block.ids, deg=block.found.astype(np.int64))
                continue
            a, b = met
            near = a.vec @ b.vec.T >= threshold
            count(a, np.count_nonzero(near, axis=1))
            if a is not b:
                count(b, np.count_nonzero(near, axis=0))

    return dealt.met(work, "i long, deg long").groupBy("i").agg(F.sum("deg").alias("deg")).filter("deg > 0")


def reached(dealt: Dealt) -> DataFrame:
    """id, first: the first place of an asked vector that reaches each; vectors of place ``NOWHERE`` aren't asked, and unreached ones are left out."""
    threshold = dealt.threshold

    def first(near: np.ndarray, place: np.ndarray, block: Block) -> None:
        """``near``: asked vectors, by place, against those of the block."""
        k = near.argmax(axis=0)
        found = np.where(near[k, np.arange(near.shape[1])], place[k], NOWHERE)
        block.found = found if block.found is None else np.minimum(block.found, found)

    def work(batches):
        for met in _meetings(batches):
            if isinstance(met, list):
                for block in met:
                    if block.found is not None:
                        some = block.found < NOWHERE
                        yield _batch(id=block.ids[some], first=block.found[some])
                continue
            a, b = met
            both = a.vec @ b.vec.T >= threshold if a.asked == len(a.ids) and (a is b or b.asked == len(b.ids)) else None
            if a.asked:
                first(both if both is not None else a.vec[: a.asked] @ b.vec.T >= threshold, a.place[: a.asked], b)
            if b.asked and a is not b:
                first(both.T if both is not None else b.vec[: b.asked] @ a.vec.T >= threshold, b.place[: b.asked], a)

    return dealt.met(work, "id long, first long").groupBy("id").agg(F.min("first").alias("first"))


def _in_order(dealt: Dealt) -> tuple[DataFrame, Dealt]:
    """i, deg, place by most neighbours, then smallest id; and the vectors with their places."""
    order = settle(ranked(settle(degrees(dealt), "degrees"), [F.desc("deg"), F.col("i")], "place"), "dense-places")
    rows = dealt.rows.drop("place").join(order.select(F.col("i").alias("id"), "place"), "id")
    return order, dealt.with_rows(settle(rows, "dense-placed"))


def _seeded(first: DataFrame, order: DataFrame) -> DataFrame:
    seeds = order.select(F.col("place").alias("first"), F.col("i").alias("seed"), "deg")
    return first.join(seeds, "first").select(F.col("id").alias("member"), "seed", "deg")


def communities(vectors: DataFrame, threshold: float) -> DataFrame:
    """``similarity.communities`` of the pairs of the threshold: member, seed, deg."""
    order, dealt = _in_order(deal(vectors, threshold))
    return _seeded(reached(dealt), order)


def communities_mis(vectors: DataFrame, threshold: float) -> DataFrame:
    """``similarity.communities_mis`` of the pairs of the threshold: member, seed, deg.

    Of the first open vectors in order, those that no earlier open one reaches
    are seeds; they and all they reach are closed.  Each round looks at twice
    as many of the first as the one before, so that the many vectors the first
    seeds close are never compared with each other again.
    """
    order, dealt = _in_order(deal(vectors, threshold))
    open_, seeds, size = dealt.rows, None, FIRST
    while True:
        if open_.isEmpty():
            break
        last = _place_of(open_.select("place"), size)
        some = open_ if last is None else open_.filter(F.col("place") <= last)
        found = reached(dealt.with_rows(some))
        # A short vector may not reach itself; it is a seed all the same.
        found = settle(some.select("id", "place").join(found, "id", "left").filter("first IS NULL OR first >= place").select("id", "place"), "seeds")
        seeds = found if seeds is None else seeds.union(found)
        closed = reached(dealt.with_rows(_asking(open_, found)))
        open_ = settle(open_.join(closed.select("id").union(found.select("id")), "id", "left_anti"), "open")
        size *= 2
    if seeds is None:
        return _seeded(reached(dealt), order)
    return _seeded(reached(dealt.with_rows(_asking(dealt.rows, seeds))), order)


def _place_of(places: DataFrame, n: int) -> int | None:
    """A place that about ``n`` places come up to (any will do); None: all do."""
    count, least, most = places.agg(F.count(F.lit(1)), F.min("place"), F.max("place")).first()
    if count <= n:
        return None
    return max(least, int(places.agg(F.percentile_approx("place", n / count, 10_000)).first()[0]))


def _asking(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """``rows`` of which only the seeds ask."""
    asks = seeds.select("id", F.col("place").alias("asks"))
    return rows.join(asks, "id", "left").withColumn("place", F.coalesce("asks", F.lit(NOWHERE))).drop("asks")


def best_pairs(vectors: DataFrame, low: float, high: float, n: int) -> DataFrame:
    """i, j, cos: the n pairs i < j of largest product in [low, high), ties to the larger i, then j.

    Of each pair of groups its n best are kept.  A matrix product rounds by
    the place of a vector in it, so products near the bounds are summed anew.
    """

    def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for d in range(x.shape[1]):
            total += x[:, d] * y[:, d]
        return total

    def work(batches):
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for met in _meetings(batches):
            if isinstance(met, list):
                yield _batch(i=best[0], j=best[1], cos=best[2])
                best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
                continue
            a, b = met
            dots = a.vec @ b.vec.T
            bar = max(low, best[2][-1]) if len(best[2]) == n else low
            p, q = np.nonzero((dots >= bar - SLACK) & (dots < high + SLACK))
            for k in range(0, len(p), 65_536):  # a block of equal vectors has very many
                pk, qk = p[k : k + 65_536], q[k : k + 65_536]
                cos, i, j = exact(a.vec[pk], b.vec[qk]), a.ids[pk], b.ids[qk]
                fits = (cos >= low) & (cos < high) & ((i < j) if a is b else (i != j))
                i, j = np.minimum(i, j), np.maximum(i, j)
                i, j, cos = (np.r_[old, new[fits]] for old, new in zip(best, (i, j, cos)))
                order = np.lexsort((-j, -i, -cos))[:n]
                best = (i[order], j[order], cos[order])

    found = deal(vectors, low).met(work, "i long, j long, cos double")
    return found.orderBy(F.desc("cos"), F.desc("i"), F.desc("j")).limit(n)
