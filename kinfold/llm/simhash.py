"""SimHash near-duplicates: pigeonhole blocks, then Hamming distance.

A fingerprint has a bit set where more than half of the XXH64 hashes of the
text's word shingles have it.  Fingerprints link at ``distance`` or fewer
differing bits.  Each distinct fingerprint is handled once, however many
documents share it.

Fingerprints are cut into more blocks than may differ, so a close pair agrees
on ``blocks - distance`` of them: every choice of that many blocks is a join
key.  A key with more than ``LIMIT`` fingerprints is split again on the bits
that vary inside it, by the same argument, until every group is small; nothing
is dropped.  Inside a group all pairs are verified and a spanning forest of
the links is kept, never all pairs.

Rows are documents: a doc_id that repeats does not link its rows by itself.
Null text has no words; a text with fewer words than a shingle is one shingle;
no words give fingerprint zero, linked like any other.  Rows with a null
doc_id are classed like others, but never name a class.  An empty table gives
an empty answer.  ``keep_one`` keeps all columns, whatever they are called; of
rows alike in doc_id and text the one whose other columns come first as JSON
stays.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import prepare, settle
from .components import components

SHINGLE, SEED, DISTANCE, BLOCKS = 3, 42, 3, 5
#: Fingerprints of a group that one task compares.
LIMIT = 512
#: Keys of rows (about 16 bytes each) that are broadcast at most.
MARKED = 300_000


def fingerprint(text: str) -> int:
    """The unsigned fingerprint of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist())
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row_key (equal for rows alike in id and text) and fp (signed) of each document."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fp = np.fromiter(map(fingerprint, tokens.texts_of(batch.column(2))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "row_key", "fp"])

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text").mapInArrow(run, "doc_id long, row_key long, fp long")


def _groups(bits: Column, parts: int, choose: int, width: int = 64) -> Column:
    """Keys for every choice of ``choose`` of ``parts`` blocks of a fingerprint."""
    edges = [round(width * i / parts) for i in range(parts + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    chosen = [signed(sum(masks[i] for i in c)) for c in combinations(range(parts), choose)]
    return F.array(*[F.struct(F.lit(j).alias("j"), bits.bitwiseAND(F.lit(m)).alias("v")) for j, m in enumerate(chosen)])


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints within ``distance``."""
    links, todo = [], np.ones(len(fps), bool)
    values = fps.view(np.uint64)
    for root in range(len(fps)):
        if not todo[root]:
            continue
        todo[root], front = False, [root]
        while front:
            i = front.pop()
            rest = np.flatnonzero(todo)
            near = rest[np.bitwise_count(values[rest] ^ values[i]) <= distance]
            todo[near] = False
            front += near.tolist()
            links += [(int(fps[i]), int(fps[j])) for j in near]
    return links


def links(distinct: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Links a, b between distinct fingerprints ``fp`` that connect all that are within ``distance``."""
    prepare(distinct.sparkSession)
    keyed = distinct.select("fp", F.explode(_groups(F.col("fp"), blocks, blocks - distance)).alias("g")).select(F.xxhash64("g.j", "g.v").alias("k"), "fp")
    found = None
    while True:
        stats = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.bit_or("fp").alias("some"), F.bit_and("fp").alias("all")).filter("n > 1")
        stats = settle(stats, "groups")
        small = keyed.join(stats.filter(F.col("n") <= LIMIT).select("k"), "k").groupBy("k").agg(F.collect_list("fp").alias("fps")).select("fps")

        def run(batches):
            for batch in batches:
                out = [link for fps in batch.column(0).to_pylist() for link in _forest(np.array(fps, np.int64), distance)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

        got = small.mapInArrow(run, "a long, b long")
        found = got if found is None else found.unionByName(got)
        large = stats.filter(F.col("n") > LIMIT).select("k", F.col("some").bitwiseXOR(F.col("all")).alias("vary"))
        if large.isEmpty():
            return found
        keyed = settle(keyed.join(large, "k").select("k", "fp", "vary").select(F.explode(_split(distance)).alias("g"), "k", "fp").select(F.xxhash64("k", "g.j", "g.v").alias("k"), "fp"), "split")


def _split(distance: int) -> Column:
    """Keys on the varying bits of a group, dealt by rank to distance + 1 blocks; one block always agrees."""
    parts = distance + 1
    rank = "aggregate(sequence(0, 63), struct(array({zeros}) as m, 0 as r), (s, b) -> if(shiftright(vary, b) & 1L = 1L, struct(transform(s.m, (x, i) -> if(i = s.r % {parts}, x | shiftleft(1L, b), x)) as m, s.r + 1 as r), s), s -> s.m)"
    masks = F.expr(rank.format(zeros=", ".join(["0L"] * parts), parts=parts))
    return F.transform(masks, lambda m, j: F.struct(j.alias("j"), F.col("fp").bitwiseAND(m).alias("v")))


def classes(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, row_key, fp, root (the class's own fingerprint) and component_id (the smallest doc_id reachable) of each document.

    Only ``root`` tells classes apart: component_id is null where all ids of a class are, and a repeated id may name two.
    """
    prints = settle(fingerprints(docs), "fingerprints")
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), distance, blocks))
    members = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    members = settle(members, "members")
    ids = members.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(members.join(ids, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "row_key", "fp", "root", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """One document of each class, the one with the smallest doc_id, with all its columns.

    Which rows go is decided by their keys.  Up to MARKED keys of rows that go, or
    that stand several times, are broadcast, counted first, and no text is
    shuffled but those of rows that stand several times; beyond, the join shuffles.
    """
    key, turn, gone = "__kinfold_key", "__kinfold_turn", "__kinfold_gone"
    found = settle(classes(docs, distance, blocks).select("doc_id", "row_key", "root"), "classes")
    first = found.groupBy("root").agg(F.min_by("row_key", F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "row_key")).alias("row_key")).select("row_key", F.lit(False).alias("gone"))
    keys = found.groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).join(first.distinct(), "row_key", "left")
    marked = keys.select(F.col("row_key").alias(key), F.coalesce("gone", F.lit(True)).alias(gone), "n").filter(F.col(gone) | (F.col("n") > 1)).drop("n")
    marked = settle(marked, "marked")
    some = marked.groupBy(gone).agg(F.count(F.lit(1)).alias("n")).collect()  # two rows at most
    few = F.broadcast(marked) if sum(r["n"] for r in some) <= MARKED else marked
    rows = docs.withColumn(key, F.xxhash64("doc_id", "text")).join(few, key, "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = rows.filter(F.col(gone).isNull()).select(*columns)
    if all(r[gone] for r in some):
        return once
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*others)) if others else F.lit(0)
    several = rows.filter(~F.col(gone)).withColumn(turn, F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col(turn) == 1)
    return once.unionByName(several.select(*columns))
