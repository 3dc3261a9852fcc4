"""Similarity join of shingle sets by Jaccard, with adaptive multi-match prefixes.

Put the tokens of all sets in one order.  A set of n tokens that links with
another has at least ``need`` = ceil(threshold * n) tokens in common with it,
so of its first n - need + k tokens it shares at least k with that partner, as
long as the partner's prefix is as long for the same k: the k first common
tokens lie in both.  Two prefixes made for k and k' share min(k, k').  A longer
prefix is read more often and asks for more matches.

1. Equal sets become one node.
2. Tokens in the order of their hashes, k a tenth of the set: only nodes with
   k prefix tokens that stand in other prefixes, too, can have partners.  The
   rest, most of a corpus, is done with.
3. What is left gets the order by frequency.  Tokens of one node only come
   first and match nothing.  Each node chooses the k whose expected work is
   least: rows to be read, and candidates to be verified at the set's length.
4. Nodes are dealt to blocks with those they share most prefix tokens with.
   Pairs of blocks that share enough prefix tokens meet in a task, which counts
   shared prefix tokens of all their nodes, verifies the whole sets of pairs
   with enough, and keeps a spanning forest of the links.  Blocks are bounded
   in nodes and tokens; a family of any size is many blocks.
5. Blocks of a family first meet themselves and its first block.  Two blocks
   whose nodes are all in one class by then need not meet.

Links are those of ``threshold``, none lost; pairs are never listed.  Null text
and text without words have an empty set, linked with nothing: such a document
is a class of its own.  Rows are documents: a repeated doc_id links nothing by
itself, a null one names no class.  An empty table gives an empty answer.
Texts are read whole, however long.  Other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import prepare, settle
from .components import components

SHINGLE, PERCENT = 4, 85
#: Nodes and tokens of a block, and columns of a token matrix at once.
BLOCK, BLOCK_TOKENS, COLUMNS = 256, 1 << 18, 4096
#: Rows of fixed-size keys that are broadcast at most; beyond, the join shuffles.
BROADCAST_ROWS = 300_000
#: Work of verifying a candidate, for each token of the set, against reading one row.
VERIFY = 0.05


def _need(n, percent: int):
    """ceil(percent * n / 100) of numbers, arrays or columns of whole numbers."""
    return F.ceil(n * percent / 100) if isinstance(n, Column) else -(-percent * n // 100)


def _first(n):
    """The matches that the first prefixes ask for."""
    return F.greatest(F.floor(n / 10), F.lit(1)) if isinstance(n, Column) else max(n // 10, 1)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def prints(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, row_key, n (set size), s1 and s2 (a set's fingerprint), prefix (in the order of hashes) of each document."""
    prepare(docs.sparkSession)
    names = ["doc_id", "row_key", "n", "s1", "s2", "prefix"]

    def run(batches):
        for batch in batches:
            found = list(shingles.sets(batch.column(2), size))
            prefixes = [h[: len(h) - _need(len(h), percent) + _first(len(h))].view(np.int64) for h in found]
            marks = [xxhash.xxh3_128_digest(h.tobytes()) for h in found]
            pair = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*prefixes, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(h) for h in found], pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), lists], names=names)

    return docs.select("doc_id", row_key().alias("row_key"), "text").mapInArrow(run, "doc_id long, row_key long, n long, s1 long, s2 long, prefix array<long>")


def may_link(nodes: DataFrame) -> DataFrame:
    """node, row_key of the nodes whose prefix shares enough tokens with other prefixes."""
    tokens = nodes.select("node", F.explode("prefix").alias("h"))
    shared = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select("h")
    matches = tokens.join(shared, "h").groupBy("node").agg(F.count(F.lit(1)).alias("m"))
    return nodes.select("node", "row_key", "n").join(matches, "node").filter(F.col("m") >= _first(F.col("n"))).select("node", "row_key")


def whole_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node, tokens of the nodes (node, row_key)."""
    texts = docs.select(row_key().alias("row_key"), "text").join(_small(nodes), "row_key").select("node", "text")

    def run(batches):
        for batch in batches:
            found = [h.view(np.int64) for h in shingles.sets(batch.column(1), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "tokens"])

    return texts.mapInArrow(run, "node long, tokens array<long>").groupBy("node").agg(F.first("tokens").alias("tokens"))


def planned(sets: DataFrame, percent: int) -> DataFrame:
    """node, n, k (the matches a pair must have), prefix, tokens (those of other nodes too) of nodes that can have partners."""
    tokens = sets.select("node", F.explode("tokens").alias("h"))
    often = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = tokens.join(often, "h").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("a"))  # a node's own tokens
    known = sets.select("node", F.size("tokens").cast("long").alias("n")).join(shared, "node")
    known = known.filter(F.size("a") >= _need(F.col("n"), percent)).select("node", "n", F.col("a.df").alias("df"), F.col("a.h").alias("h"))

    def run(batches):
        for batch in batches:
            rows = []
            for node, n, df, h in zip(*(batch.column(i).to_pylist() for i in range(4))):
                need, read = _need(n, percent), np.cumsum(np.array(df) - 1.0)
                k = np.arange(1, need + 1)
                length = len(h) - need + k  # tokens of this node alone, which come first, are left out
                best = int(np.argmin(read[length - 1] * (1 + VERIFY * n / k)))
                rows.append((node, n, best + 1, h[: length[best]], h))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["node", "n", "k", "prefix", "tokens"])

    return known.mapInArrow(run, "node long, n long, k long, prefix array<long>, tokens array<long>")


def placed(plan: DataFrame) -> DataFrame:
    """``plan`` with lead (the node that most of a node's prefix tokens have as their first), part and block."""
    tokens = plan.select("node", F.explode("prefix").alias("h"))
    firsts = tokens.groupBy("h").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("df")).filter("df > 1").select("h", "lead")
    led = tokens.join(firsts, "h").groupBy("node", "lead").agg(F.count(F.lit(1)).alias("m"))
    lead = settle(led.groupBy("node").agg(F.max_by("lead", F.struct("m", -F.col("lead"))).alias("lead")), "leads")
    sizes = plan.select("node", F.size("tokens").alias("size")).join(lead, "node")
    parts = sizes.groupBy("lead").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_TOKENS)).alias("parts"))
    dealt = plan.join(lead, "node").join(parts, "lead").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    return dealt.select("node", "n", "k", "prefix", "tokens", "lead", "part", F.xxhash64("lead", "part").alias("block"))


def block_pairs(nodes: DataFrame) -> DataFrame:
    """x, y (x <= y), near: the pairs of blocks that share as many prefix tokens as some pair of their nodes must."""
    blocks = nodes.groupBy("block").agg(F.min("k").alias("k"), F.first("lead").alias("lead"), F.first("part").alias("part"), F.count(F.lit(1)).alias("nodes"))
    blocks = settle(blocks, "blocks")
    tokens = settle(nodes.select("block", F.explode("prefix").alias("h")).distinct(), "block-tokens")
    often = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h")
    some = tokens.join(often, "h")
    met = some.withColumnRenamed("block", "x").join(some.withColumnRenamed("block", "y"), "h").filter("x < y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("m"))
    side = lambda c: blocks.select(F.col("block").alias(c), F.col("k").alias(f"k{c}"), F.col("lead").alias(f"l{c}"), F.col("part").alias(f"p{c}"))
    met = met.join(side("x"), "x").join(side("y"), "y").filter(F.col("m") >= F.least("kx", "ky"))
    met = met.select("x", "y", ((F.col("lx") == F.col("ly")) & ((F.col("px") == 0) | (F.col("py") == 0))).alias("near"))
    return met.unionByName(blocks.filter("nodes > 1").select(F.col("block").alias("x"), F.col("block").alias("y"), F.lit(True).alias("near")))


def common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many tokens each of the first sets has in common with each of the second."""
    both = [*a, *b]
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    _, column, times = np.unique(np.concatenate([*both, np.empty(0, np.int64)]), return_inverse=True, return_counts=True)
    left = row < len(a)
    used = (np.bincount(column[left], minlength=len(times)) > 0) & (np.bincount(column[~left], minlength=len(times)) > 0)
    number = np.cumsum(used) - 1
    keep = used[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, int(used.sum()), COLUMNS):
        i, j = np.searchsorted(column, [at, at + COLUMNS])
        has = np.zeros((len(both), min(COLUMNS, int(used.sum()) - at)), np.float32)
        has[row[i:j], column[i:j] - at] = 1
        out += has[: len(a)] @ has[len(a) :].T
    return out.astype(np.int64)


def _linked(a: pd.DataFrame, b: pd.DataFrame, percent: int) -> np.ndarray:
    """Which nodes of one block link with which of another: enough shared prefix tokens, then the whole sets."""
    rows, others = list(a["prefix"]), list(b["prefix"])
    chosen = common(rows, others) >= np.minimum.outer(a["k"].to_numpy(), b["k"].to_numpy())
    i, j = np.flatnonzero(chosen.any(axis=1)), np.flatnonzero(chosen.any(axis=0))
    found = np.zeros(chosen.shape, bool)
    if len(i):
        same = common([a["tokens"].iloc[x] for x in i], [b["tokens"].iloc[x] for x in j])
        union = np.add.outer(a["n"].to_numpy()[i], b["n"].to_numpy()[j]) - same
        found[np.ix_(i, j)] = (100 * same >= percent * union) & chosen[np.ix_(i, j)]
    return found


def _forest(link: np.ndarray, nodes: np.ndarray) -> pd.DataFrame:
    """A spanning forest of a symmetric matrix of links."""
    out, todo = [], np.ones(len(nodes), bool)
    for root in range(len(nodes)):
        if todo[root]:
            todo[root], front = False, [root]
            while front:
                i = front.pop()
                near = np.flatnonzero(link[i] & todo)
                todo[near] = False
                front += near.tolist()
                out += [(nodes[i], nodes[j]) for j in near]
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links a, b that connect all nodes of the paired blocks that link."""
    columns = ["block", "node", "n", "k", "prefix", "tokens"]
    left = pairs.select("x", "y").join(nodes.select(*columns).withColumnRenamed("block", "x"), "x")
    right = pairs.select("x", "y").filter("x <> y").join(nodes.select(*columns).withColumnRenamed("block", "y"), "y")
    right = right.select(*[F.col(c).alias(f"{c}_") for c in right.columns])  # names of its own: both sides come from one table

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(b):
            b = b.rename(columns=lambda c: c[:-1])
            found, n = _linked(a, b, percent), len(a)
            whole = np.zeros((n + len(b), n + len(b)), bool)
            whole[:n, n:], whole[n:, :n] = found, found.T
            return _forest(whole, np.concatenate([a["node"], b["node"]]))
        return _forest(_linked(a, a, percent), a["node"].to_numpy())

    return left.groupBy("x", "y").cogroup(right.groupBy("x_", "y_")).applyInPandas(meet, "a long, b long")


def links(docs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """Links a, b that connect all nodes (node, row_key, n, prefix) within the threshold."""
    few = settle(may_link(nodes), "may-link")
    plan = settle(planned(settle(whole_sets(docs, few, size), "sets"), percent), "prefixes")
    where = settle(placed(plan), "placed")
    pairs = settle(block_pairs(where), "block-pairs")
    near = settle(verified(pairs.filter("near"), where, percent), "near-links")
    roots = where.select("node", "block").join(components(near), "node", "left").select("block", F.coalesce("root", "node").alias("root"))
    one = settle(roots.groupBy("block").agg(F.min("root").alias("r"), (F.min("root") == F.max("root")).alias("whole")).filter("whole"), "whole-blocks")
    done = lambda c: one.select(F.col("block").alias(c), F.col("r").alias(f"r{c}"))
    open_ = pairs.filter("NOT near").join(done("x"), "x", "left").join(done("y"), "y", "left").filter("rx IS NULL OR ry IS NULL OR rx <> ry")
    return near.unionByName(verified(settle(open_.select("x", "y"), "open-pairs"), where, percent))


def classes(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of each document."""
    found = settle(prints(docs, size, percent), "shingle-prints")
    nodes = found.filter("n > 0").groupBy("s1", "s2").agg(F.first("n").alias("n"), F.first("row_key").alias("row_key"), F.min("doc_id").alias("least"), F.first("prefix").alias("prefix"))
    nodes = settle(nodes.withColumn("node", F.monotonically_increasing_id()), "shingle-sets")
    roots = components(links(docs, nodes.select("node", "row_key", "n", "prefix"), size, percent))
    members = settle(nodes.select("node", "s1", "s2", "least").join(roots, "node", "left").select("s1", "s2", "least", F.coalesce("root", "node").alias("root")), "members")
    ids = members.groupBy("root").agg(F.min("least").alias("component_id"))
    known = members.join(ids, "root").select("s1", "s2", "component_id", F.lit(True).alias("known"))
    both = found.select("doc_id", "n", "s1", "s2").join(known, ["s1", "s2"], "left")
    return both.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
