"""Repair of conversation structure by a time-major dynamic programme over many conversations at once.

A sound conversation's role initials are ``(s?(ua)+)?``.  Edits: keep a row (K),
give it another role (R), delete it (D), insert an empty turn (I), at the costs
below.  Rows without a visible character and rows whose role and text stood
before must go; a row whose text doesn't end a sentence costs more if it stays.

Rows become codes of one byte: role initial and fault.  Conversations of like
length form a bucket, a matrix of codes with one row for each turn, and the
least costs from each of four states to the end are found for all of them turn
by turn, from the back.  They are stored, so that all conversations' edits are
traced together from the front: at each step the first letter, in ASCII, that
keeps the least cost.  Which role an edit gives follows from the state, so the
letters tell all.

The order within a conversation is that of turn (null first), then role, then
text.  Null role or text is one space, as is a null in the text that damage is
drawn from; rows with a null conv_id form a conversation.  A conversation whose
rows are all gone has zeros and no edits.  An empty table gives an empty
answer.  Texts are never held for a whole conversation; its codes and edits,
a few bytes a row, meet in one task, as they do in its row of the answer.
Other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, settle
from .running import digests, running
from .trie import EMPTY

#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows whose codes are one piece, and cells of a bucket's matrix.
PIECE, CELLS = 1024, 1 << 18
#: Fixed value: white space of the rules.
WHITE = " \t\n\x0b\x0c\r"

# Role initials: s, u, a and any other.  Faults: none, blank, duplicate, truncated.  A code is 4 * initial + fault.
S, U, A, OTHER, PAD = 0, 1, 2, 3, 16
BLANK, DUPLICATE, CUT = 1, 2, 3
# States: nothing yet; after s; after u; after a.  What a new turn makes of a state, and its role.
NEXT, GIVES = np.array([2, 2, 3, 2]), np.array([U, U, A, U])
#: From a state with an initial to a state, or -1.
STEP = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
ENDS = np.array([0, 2 * INSERT, INSERT, 0])
_FAR = 1 << 28
_D, _I, _K, _R = (ord(c) for c in "DIKR")
#: What is inserted before a row, by how: nothing, u, a, ua, au.
_GROWN = np.array([[0, 1, 2], [0, 0, 4], [0, 3, 0], [0, 0, 0], [0, 0, 0]])


def backward(codes: np.ndarray) -> np.ndarray:
    """Least costs to the end [turn, state, conversation] for codes [turn, conversation]; PAD fills up at the end."""
    turns, width = codes.shape
    cost = np.empty((turns + 1, 4, width), np.int32)
    cost[turns] = ENDS[:, None]
    for t in range(turns - 1, -1, -1):
        after, code = cost[t + 1], codes[t]
        initial, fault = code // 4, code % 4
        extra = np.where(fault == CUT, TRUNCATED, 0) + np.where((fault == BLANK) | (fault == DUPLICATE), _FAR, 0)
        best = np.minimum(after + DELETE, after[NEXT] + REROLE + extra)
        for state in range(4):
            for i in (S, U, A):
                if STEP[state, i] >= 0:
                    best[state] = np.minimum(best[state], np.where(initial == i, after[STEP[state, i]] + extra, _FAR))
        best = np.minimum(best, np.minimum(best[NEXT] + INSERT, best[NEXT[NEXT]] + 2 * INSERT))
        cost[t] = np.where(code == PAD, after, best)
    return cost


def traced(codes: np.ndarray, lengths: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edits [step, conversation] (0 when done), what is done at each row [turn, conversation] (5 * deed + inserts before), inserts at the end.

    Deeds: 0 deleted, 1 kept, 2 made a user's, 3 made an assistant's.
    """
    turns, width = codes.shape
    lane, at, state, grown = np.arange(width), np.zeros(width, np.int64), np.zeros(width, np.int64), np.zeros(width, np.int64)
    deeds, edits = np.zeros((turns, width), np.uint8), []
    padded = np.concatenate([codes, np.full((1, width), PAD, codes.dtype)])
    while True:
        left = at < lengths
        open_ = left | (cost[at, state, lane] > 0)
        if not open_.any():
            return np.array(edits, np.uint8).reshape(-1, width), deeds, grown
        now, then = cost[at, state, lane], np.minimum(at + 1, turns)
        code = padded[at, lane]
        extra = np.where(code % 4 == CUT, TRUNCATED, 0)
        delete = left & (cost[then, state, lane] + DELETE == now)
        insert = open_ & ~delete & (cost[at, NEXT[state], lane] + INSERT == now)
        to = STEP[state, np.minimum(code // 4, OTHER)]
        keep = left & ~delete & ~insert & (to >= 0) & (code % 4 != BLANK) & (code % 4 != DUPLICATE) & (cost[then, to, lane] + extra == now)
        rerole = left & ~delete & ~insert & ~keep
        gives = GIVES[state]
        edits.append(np.select([delete, insert, keep, rerole], [_D, _I, _K, _R], 0).astype(np.uint8))
        deed = np.select([delete, keep, rerole], [0, 1, 1 + gives], 0)
        moved = delete | keep | rerole
        deeds[at[moved], lane[moved]] = (5 * deed + grown)[moved]
        grown = np.where(moved, 0, np.where(insert, _GROWN[grown, gives], grown))
        state = np.where(insert | rerole, NEXT[state], np.where(keep, to, state))
        at = at + moved


def solved(texts: list[bytes]) -> list[tuple]:
    """For each conversation's codes: rows of each fault (blank, duplicate, truncated), illegal neighbours, cost, edits, deeds (A, B, ...), inserts at the end."""
    out: list = [None] * len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    order, at = np.argsort(sizes, kind="stable"), 0
    legal = np.zeros((4, 4), bool)
    legal[[S, U, A], [U, A, U]] = True
    while at < len(order):
        # A bucket: lengths within a factor of two, and so many conversations as the matrix may hold.
        longest = max(2 * int(sizes[order[at]]), 1)
        stop = at + 1
        while stop < len(order) and sizes[order[stop]] <= longest and (stop - at + 1) * int(sizes[order[stop]]) <= CELLS:
            stop += 1
        some, lengths = order[at:stop], sizes[order[at:stop]]
        codes = np.full((int(lengths.max()), len(some)), PAD, np.uint8)
        for k, i in enumerate(some.tolist()):
            codes[: sizes[i], k] = np.frombuffer(texts[i], np.uint8) - 65
        faults = [((codes % 4 == f) & (codes != PAD)).sum(axis=0) for f in (BLANK, DUPLICATE, CUT)]
        pairs = (codes[1:] != PAD) & ~legal[np.minimum(codes[:-1] // 4, OTHER), np.minimum(codes[1:] // 4, OTHER)]
        cost = backward(codes)
        edits, deeds, tails = traced(codes, lengths, cost)
        for k, i in enumerate(some.tolist()):
            column = edits[:, k]
            out[i] = (*(int(f[k]) for f in faults), int(pairs[:, k].sum()), int(cost[0, 0, k]), column[column > 0].tobytes().decode(), (deeds[: sizes[i], k] + 65).tobytes().decode(), int(tails[k]))
        at = stop
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after the contract's damage: key (conv_id as text, empty for null), turn, role, text."""
    space = F.lit(" ")
    drawn = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    hit = rows.select(keyed().alias("key"), "turn", role.alias("role"), text.alias("text"), drawn.alias("k")).filter("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    again = F.explode(F.sequence(F.lit(0), F.when(F.col("k") == 3, 1).otherwise(0)))
    return hit.select("key", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), again.alias("copy")).drop("copy")


def keyed() -> Column:
    return F.coalesce(F.col("conv_id").cast("string"), F.lit(""))


def _line(role: Column, text: Column, deed: Column) -> Column:
    """The lines that a row and what is inserted before it leave, or null."""
    inserted = F.element_at(F.array(*[F.array(*[F.lit(f"{r}:") for r in how]).cast("array<string>") for how in ([], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"])]), (deed % 5 + 1).cast("int"))
    new = F.element_at(F.array(F.lit(None).cast("string"), role, F.lit("user"), F.lit("assistant")), (F.floor(deed / 5) + 1).cast("int"))
    lines = F.concat(inserted, F.when(new.isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(new, F.lit(":"), text))))
    return F.when(F.size(lines) > 0, F.concat_ws("\n", lines))


def repaired(rows: DataFrame) -> DataFrame:
    """key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of conversations (key, turn, role, text)."""
    prepare(rows.sparkSession)
    seen = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    first = F.when(initial == "s", S).when(initial == "u", U).when(initial == "a", A).otherwise(OTHER)
    fault = F.when(seen == "", BLANK).when(F.right(seen, F.lit(1)).isin(".", "!", "?"), 0).otherwise(CUT)
    keep = ["key", "turn", "role", "text", first.alias("initial"), fault.alias("fault")]
    placed = running(rows, "key", ["key", F.col("turn").asc_nulls_first(), "role", "text"], keep, {}, "conversation-rows")
    said = [F.xxhash64("role", "text").alias("t1"), F.xxhash64("text", "role", F.lit("other")).alias("t2")]
    told = placed.filter(F.col("fault") != BLANK).select("key", "place", *said)
    first_told = told.groupBy("key", "t1", "t2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "t1", "t2", "first")
    marked = placed.select("key", "place", "initial", "fault", *said).join(first_told, ["key", "t1", "t2"], "left")
    code = 4 * F.col("initial") + F.when((F.col("fault") != BLANK) & (F.col("place") > F.col("first")), DUPLICATE).otherwise(F.col("fault"))
    letter = F.char((code + 65).cast("long"))
    piece = F.floor((F.col("place") - 1) / PIECE).alias("piece")
    joined = lambda place, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, text))), lambda x: x[text]), "")
    pieces = marked.select("key", piece, "place", letter.alias("letter")).groupBy("key", "piece").agg(joined("place", "letter").alias("codes"))
    codes = settle(pieces.groupBy("key").agg(joined("piece", "codes").alias("codes")), "codes")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                columns = zip(*solved([t.encode() for t in batch.column(1).to_pylist()]))
                kinds = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["key", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "deeds", "tail"])

    schema = "key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, deeds string, tail long"
    edits = settle(codes.sortWithinPartitions(F.length("codes")).mapInArrow(run, schema), "edits")
    cut = F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("deeds") - 1) / PIECE).cast("int")), lambda i: F.substring(F.col("deeds"), i * PIECE + 1, F.lit(PIECE))))
    deeds = edits.filter("deeds <> ''").select("key", cut.alias("piece", "deeds")).withColumn("piece", F.col("piece").cast("long"))
    deed = F.ascii(F.substring(F.col("deeds"), F.pmod(F.col("place") - 1, F.lit(PIECE)).cast("int") + 1, F.lit(1))) - 65
    lines = placed.withColumn("piece", piece).join(deeds, ["key", "piece"]).select("key", "place", _line(F.col("role"), F.col("text"), deed).alias("line"))
    tails = edits.filter("tail > 0").select("key", F.lit(2**62).alias("place"), _line(F.lit(None).cast("string"), F.lit(""), F.col("tail")).alias("line"))
    marks = digests(lines.unionByName(tails).filter("line IS NOT NULL"), ["key"], "place", "line", "\n")
    turns = placed.select("key", "turn").distinct().groupBy("key").agg(F.count("turn").alias("c"), F.max("turn").alias("hi"), F.min("turn").alias("lo"))
    gaps = turns.select("key", F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("c"), F.lit(0)).alias("gaps"))
    whole = edits.join(gaps, "key").join(marks, "key", "left")
    return whole.select("key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha256", F.lit(EMPTY)).alias("repaired_sha256"))


def audited(original: DataFrame, rows: DataFrame) -> DataFrame:
    """The repair of ``rows`` (key, turn, role, text) for every conversation of ``original``, also those that have no rows."""
    found = original.select(keyed().alias("key"), "conv_id").distinct().join(repaired(rows), "key", "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"))
