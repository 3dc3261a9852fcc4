"""Best-fit packing of documents into sequences by bin completion.

Documents longer than a sequence are cut into full pieces from the end, so
only the first piece is shorter.  Pieces of one length are alike, so the
search runs on the histogram of lengths, of at most ``capacity`` rows, and its
answer is a list of fillings with the number of sequences that use each.  Each
piece then finds its place from its rank among the pieces of its length.  The
histogram is all that reaches the driver, whatever the corpus holds.

The search: best-fit decreasing gives the incumbent.  If it has more sequences
than the lower bound, a branch-and-bound takes the largest piece left and
enumerates the undominated fillings around it, of any number of pieces and
least waste first, one at a time as they are asked for.  It branches on the
filling and on how many sequences have it, and gives up a branch whose waste
cannot lead to fewer sequences than the incumbent.  Before that it goes straight
down a few times, each time with another waste that it tolerates in a sequence:
of the fillings within it, that of the fewest pieces is taken, as the short
pieces spared so fill up the sequences that come later.

Null text is empty: the document is its end id.  Repeated rows, and rows with
a null doc_id, are packed each.  Pieces of one length are alike: which of them
comes first is the order in which tasks meet them.  An empty table gives an
empty answer.  Other columns are left out.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import prepare, settle

CAPACITY = 2048
#: Fillings that each pass of the branch-and-bound looks at before it keeps the incumbent.
NODES = 16_000
#: Fillings of a piece that the first of the two passes tries; the second tries all.
NARROW = 3
#: Levels of the search that keep their enumeration in memory.
LIVE = 64
#: Waste that the ways straight down tolerate, as parts of a sequence.
TOLERATED = (512, 256, 170, 128, 85, 64, 42)
#: Fillings that a way straight down looks at around a piece.
LOOKS = 500
#: They are taken while the incumbent is over the lower bound by more than one sequence in so many.
CLOSE = 1000

Filling = tuple[int, ...]


def lower_bound(counts: np.ndarray) -> int:
    """The least number of bins: by total length, and with pieces over half a bin (Martello and Toth's L2)."""
    c = len(counts) - 1
    sizes = np.arange(c + 1)
    n, total = np.cumsum(counts), np.cumsum(counts * sizes)
    best = -(-int(total[-1]) // c)
    half = c // 2
    for k in range(half + 1):
        alone = int(n[c] - n[c - k])  # too long to stand with a piece of length k
        middle = int(n[c - k] - n[half])
        free = middle * c - int(total[c - k] - total[half])
        small = int(total[half] - (total[k - 1] if k else 0))
        best = max(best, alone + middle + max(0, -(-(small - free) // c)))
    return best


def best_fit(counts: np.ndarray) -> list[tuple[Filling, int]]:
    """Best-fit decreasing over the histogram: fillings and how many bins have each."""
    c = len(counts) - 1
    open_: list[list[list]] = [[] for _ in range(c + 1)]  # by free room: [filling, bins]
    for size in range(c, 0, -1):
        left = int(counts[size])
        room = size
        while left and room <= c:
            if not open_[room]:
                room += 1
                continue
            filling, bins = open_[room].pop()
            used = min(left, bins)
            if used < bins:
                open_[room].append([filling, bins - used])
            open_[room - size].append([(*filling, size), used])
            left -= used
            if room - size >= size:
                room = size  # the bin just filled may be the best fit again
        per = c // size
        if left >= per:
            open_[c - per * size].append([(size,) * per, left // per])
        if left % per:
            open_[c - left % per * size].append([(size,) * (left % per), 1])
    merged: dict[Filling, int] = {}
    for filling, bins in (x for group in open_ for x in group):
        merged[filling] = merged.get(filling, 0) + bins
    return list(merged.items())


def _set_of(present: np.ndarray) -> int:
    """The indexes where ``present`` holds, as bits of a number."""
    return int.from_bytes(np.packbits(present, bitorder="little").tobytes(), "little")


def dominated(filling: Filling, waste: int, spare: int) -> bool:
    """Whether a spare length (bits of ``spare``) can replace some pieces that are together no longer, or none.

    Then the filling with the replacement is at least as good (Martello and
    Toth).  One replacement at a time finds every dominated filling.
    """
    some = several = 0  # sums of at least one and at least two pieces
    for size in filling:
        several |= some << size
        some |= some << size | 1 << size
    shorter, by = (some | 1) << 1, 1  # lengths above a sum of pieces by 1 to waste
    if not waste:
        return bool(several & spare)
    while by < waste:
        step = min(by, waste - by)
        shorter |= shorter << step
        by += step
    return bool((shorter | several) & spare)


def completions(counts: np.ndarray, room: int, most: int | None = None) -> Iterator[Filling | None]:
    """Undominated fillings of ``room`` that waste ``most`` at most, least waste first, longer pieces first.

    None stands for a dominated one, so that the caller can count it.  The
    sums that shorter lengths can make are known, so no choice is a dead end.
    """
    sizes = np.flatnonzero(counts[: room + 1] > 0).tolist()
    have = [min(int(counts[s]), room // s) for s in sizes]
    every = (1 << room + 1) - 1
    sums = [1]  # sums of lengths before each one, as bits; all from the last on
    for size, n in zip(sizes, have):
        made, k = sums[-1], 1
        if made == every:
            break
        while n:
            made |= made << size * min(k, n) & every
            n, k = n - min(k, n), 2 * k
        sums.append(made)

    def exact(total: int, upto: int) -> Iterator[Filling]:
        if not total:
            yield ()
            return
        for j in range(bisect_right(sizes, total, 0, upto) - 1, -1, -1):
            size, below = sizes[j], sums[min(j, len(sums) - 1)]
            for k in range(min(have[j], total // size), 0, -1):
                if below >> total - k * size & 1:
                    for more in exact(total - k * size, j):
                        yield (size,) * k + more

    for waste in range(room + 1 if most is None else min(room, most) + 1):
        if sums[-1] >> room - waste & 1:
            for filling in exact(room - waste, len(sizes)):
                left = counts[: room + 1] > 0
                for size in set(filling):
                    left[size] = counts[size] > filling.count(size)
                yield None if dominated(filling, waste, _set_of(left)) else filling


def choices(left: np.ndarray, most: int, banned: set[Filling], narrow: bool) -> Iterator[tuple[Filling, int] | None]:
    """Fillings around the largest piece and the number of sequences that have them, down to one; None as above.

    If ``narrow``, NARROW fillings only, each in as many sequences as it can be.
    """
    given = 0
    size = int(left.nonzero()[0][-1])
    rest, room = left.copy(), len(left) - 1 - size
    rest[size] -= 1
    for others in completions(rest, room, most):
        if others is None or (size, *others) in banned:
            yield None
            continue
        filling, waste = (size, *others), room - sum(others)
        times = min(int(left[s]) // filling.count(s) for s in set(filling))
        for n in range(min(times, most // waste) if waste else times, 0, -1):
            yield filling, n
            if narrow:
                break
        given += 1
        if narrow and given == NARROW:
            return


def thrifty(left: np.ndarray, tolerated: int, most: int) -> Filling | None:
    """The filling around the largest piece of the fewest pieces, then of the least waste, that wastes no more than is tolerated.

    If none is within that, the one of least waste; none if it wastes more than ``most``.
    """
    size = int(left.nonzero()[0][-1])
    rest, room = left.copy(), len(left) - 1 - size
    rest[size] -= 1
    fit = rest[: room + 1].nonzero()[0]
    fewest = -(-max(room - tolerated, 0) // int(fit[-1])) if len(fit) else 0
    best: Filling | None = None
    for others in islice(completions(rest, room, most), LOOKS):
        if others is None:
            continue
        if best is not None and room - sum(others) > tolerated:
            break
        if best is None or len(others) < len(best):
            best = others
        if len(best) <= fewest:
            break
    return None if best is None else (size, *best)


def straight(counts: np.ndarray, tolerated: int, bins: int) -> list[tuple[Filling, int]] | None:
    """One way down the search, each filling in as many sequences as it can be; none as soon as ``bins`` can't be undercut."""
    c, left, made = len(counts) - 1, counts.copy(), []
    most = (bins - 1) * c - int((counts * np.arange(c + 1)).sum())
    while left.any():
        filling = thrifty(left, tolerated, most)
        if filling is None:
            return None
        times = min(int(left[s]) // filling.count(s) for s in set(filling))
        most -= times * (c - sum(filling))
        if most < 0:
            return None
        for s in filling:
            left[s] -= times
        made.append((filling, times))
    return made


def complete(counts: np.ndarray, incumbent: list[tuple[Filling, int]], bound: int) -> list[tuple[Filling, int]]:
    """Branch-and-bound over completions; the incumbent if none is better.

    The ways straight down come first, then a narrow pass, as it goes back to early choices soon; the whole search
    starts from what they found.
    """
    for part in TOLERATED:
        bins = sum(m for _, m in incumbent)
        if (bins - bound) * CLOSE > bins:
            incumbent = straight(counts, (len(counts) - 1) // part, bins) or incumbent
    for narrow in (True, False):
        incumbent = search(counts, incumbent, bound, narrow)
    return incumbent


def search(counts: np.ndarray, incumbent: list[tuple[Filling, int]], bound: int, narrow: bool) -> list[tuple[Filling, int]]:
    """One pass over at most NODES choices, over all of them if there are fewer and it isn't narrow."""
    c, total = len(counts) - 1, int((counts * np.arange(len(counts))).sum())
    best, looked, left, used, waste = incumbent, 0, counts.copy(), 0, 0
    bins = sum(m for _, m in best)
    made: list[tuple[Filling, int]] = []
    # A filling chosen for fewer sequences than it could have has that number for good: it is banned further down.
    banned: set[Filling] = set()
    # Waste that was allowed, choices taken, the choices: all but the last LIVE are made anew when they are needed.
    stack = [[(bins - 1) * c - total, 0, None]]
    while stack and bins > bound and looked < NODES:
        level = stack[-1]
        if level[2] is None:
            level[2] = islice(choices(left, level[0], banned, narrow), level[1], None)
        choice = next(level[2], ())
        if choice == ():
            stack.pop()
            if made:
                filling, times = made.pop()
                banned.discard(filling)
                used, waste = used - times, waste - times * (c - sum(filling))
                for s in filling:
                    left[s] += times
            continue
        level[1] += 1
        looked += 1
        if choice is None:
            continue
        filling, times = choice
        now = waste + times * (c - sum(filling))
        most = (bins - 1) * c - total - now
        if most < 0:
            continue
        for s in filling:
            left[s] -= times
        if not left.any():
            best, bins = [*made, choice], used + times
            for s in filling:
                left[s] += times
            continue
        made.append(choice)
        banned.add(filling)
        used, waste = used + times, now
        stack.append([most, 0, None])
        if len(stack) > LIVE:
            stack[-LIVE - 1][2] = None
    return best


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Filling, int]]:
    """Fillings and the number of sequences of each for a histogram of piece lengths."""
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        counts[size] = n
    full, counts[capacity] = int(counts[capacity]), 0
    plan = []
    if counts.any():
        bound = lower_bound(counts)
        plan = best_fit(counts)
        if sum(m for _, m in plan) > bound:
            plan = complete(counts, plan, bound)
    return [*([((capacity,), full)] if full else []), *plan]


def places(plan: list[tuple[Filling, int]]) -> np.ndarray:
    """Rows (length << 44 | first rank, first rank, pieces a sequence, first sequence, offset), sorted."""
    rows, used, sequence = [], {}, 0
    for filling, times in plan:
        offset = 0
        for size in sorted(set(filling), reverse=True):
            k, first = filling.count(size), used.get(size, 0)
            rows.append((size << 44 | first, first, k, sequence, offset))
            used[size] = first + k * times
            offset += k * size
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, path: str | None = None) -> DataFrame:
    """The pieces of every document, with the task that made each and its rank there among pieces of its length."""
    prepare(docs.sparkSession)
    path = path or tokens.default_path()

    def run(batches):
        encode, task, seen = tokens.encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode.encode(batch.column(1))):
                ids = np.concatenate([ids, end]).astype("<u4")
                cut = len(ids) - (len(ids) - 1) // capacity * capacity
                bounds = [0, *range(cut, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    out.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), task, int(seen[b - a])))
                    seen[b - a] += 1
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank_there"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank_there long")


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each document."""
    cut = settle(pieces(docs, capacity, end_id, path), "pieces")
    counts = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    place = cut.sparkSession.sparkContext.broadcast(places(solve(histogram, capacity)))  # of the histogram's size
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank_there")).alias("rank"))

    def put(batches):
        table = place.value
        for batch in batches:
            size, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            _, first, k, sequence, offset = table[np.searchsorted(table[:, 0], (size << 44) | rank, "right") - 1].T
            turn = rank - first
            columns = [*batch.columns[:5], pa.array(sequence + turn // k), pa.array(offset + turn % k * size)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
