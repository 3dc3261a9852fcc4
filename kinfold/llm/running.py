"""Running values over rows in an order, and digests of ordered lists, with no key bound to one task.

Rows are dealt by ranges of the order, so a key with any share of the rows lies
in as many partitions as that takes.  Each partition runs through its rows
once; what a key had in the partitions before is added afterwards from one
small row for each partition.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import prepare, settle

#: What accumulates: how values add up, and how what came before is taken off again.
_ADD = {"sum": (np.cumsum, np.add, np.subtract), "xor": (np.bitwise_xor.accumulate, np.bitwise_xor, np.bitwise_xor)}
_JOIN = {"sum": lambda a, b: a + b, "xor": lambda a, b: a.bitwiseXOR(b)}


def running(rows: DataFrame, group: str | None, order: list[Column | str], keep: list[Column | str], values: dict[str, str], label: str) -> DataFrame:
    """The columns ``keep``, place (1, 2, ... in the group), and the columns of ``values`` (long) accumulated to each row.

    ``values`` names a column of ``keep`` and "sum" or "xor"; the accumulated column has the name with "run_" before.
    Without ``group`` all rows are one group.  Rows of a group are neighbours in ``order``.
    """
    prepare(rows.sparkSession)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*keep)
    names, ops = list(values), list(values.values())
    more = ["place", *(f"run_{n}" for n in names), "part", "row", "head"]
    schema = StructType.fromDDL(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields) + "".join(f", {n} long" for n in more[:-1]) + ", head boolean")
    arrow, at, value_at = to_arrow_schema(schema), dealt.columns.index(group) if group else None, [dealt.columns.index(n) for n in names]

    def run(batches):
        part, row, head, last = TaskContext.get().partitionId(), 0, True, None
        carry = [0] * (len(names) + 1)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            start = np.zeros(n, bool)
            if at is not None:
                key = batch.column(at)
                start[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
                start[0] = row > 0 and key[0].as_py() != last
                last = key[n - 1].as_py()
            firsts = np.maximum.accumulate(np.where(start, np.arange(n), 0))
            heads = np.full(n, head) & (np.cumsum(start) == 0)
            old = np.cumsum(start) == 0  # these continue the group before the batch
            out = []
            for k, (op, of) in enumerate(zip(["sum", *ops], [np.ones(n, np.int64), *(batch.column(i).to_numpy() for i in value_at)])):
                up, plus, minus = _ADD[op]
                total = up(of)
                before = np.where(firsts > 0, total[np.maximum(firsts - 1, 0)], 0)
                total = minus(total, before)
                total[old] = plus(total[old], carry[k])
                carry[k] = total[-1]
                out.append(pa.array(total, pa.int64()))
            head = bool(heads[-1])
            made = [*batch.columns, *out, pa.array(np.full(n, part), pa.int64()), pa.array(np.arange(row, row + n)), pa.array(heads)]
            row += n
            yield pa.RecordBatch.from_arrays(made, schema=arrow)

    done = settle(dealt.mapInArrow(run, schema), label)
    totals = ["place", *(f"run_{n}" for n in names)]
    ends = done.groupBy("part").agg(*[F.max_by(c, "row").alias(c) for c in totals], F.bool_and("head").alias("one"), *([F.min_by(group, "row").alias("first"), F.max_by(group, "row").alias("last")] if group else []))
    carried, before, since = [], None, [0] * len(totals)
    for end in sorted(ends.collect(), key=lambda r: r["part"]):  # one row for each partition
        same = before is not None and (group is None or before[0] == end["first"])
        here = since if same else [0] * len(totals)
        if same:
            carried.append((end["part"], *here))
        own = [end[c] for c in totals]
        since = [(x ^ y) if op == "xor" else x + y for x, y, op in zip(here, own, ["sum", *ops])] if end["one"] else own
        before = (end["last"] if group else None,)
    schema = ", ".join(["part long", *(f"c{k} long" for k in range(len(totals)))])
    carries = F.broadcast(rows.sparkSession.createDataFrame(carried, schema))
    joined = done.join(carries, "part", "left")
    fixed = {c: F.when(F.col("head") & F.col(f"c{k}").isNotNull(), _JOIN[op](F.col(c), F.col(f"c{k}"))).otherwise(F.col(c)) for k, (c, op) in enumerate(zip(totals, ["sum", *ops]))}
    return joined.withColumns(fixed).select(*dealt.columns, *totals)


def digests(rows: DataFrame, key: list[str], place: str, item: str, between: str) -> DataFrame:
    """``key`` and sha256 (lowercase hex) of each key's items in order, joined by ``between``.

    Keys aren't null, and of a simple type.  Items are joined to pieces where the
    ranges lie; of a key's pieces, in order, one task makes the digest, which can't
    be made otherwise, and holds one batch of pieces at a time.
    """
    prepare(rows.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    keys, width, mark = ", ".join(f"{k} {kinds[k]}" for k in key), len(key), between.encode()
    dealt = rows.select(*key, place, item).repartitionByRange(*key, place).sortWithinPartitions(*key, place)

    def joined(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            start = np.zeros(batch.num_rows, bool)
            start[0] = True
            for k in range(width):
                start[1:] |= pc.not_equal(batch.column(k)[1:], batch.column(k)[:-1]).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(start)
            texts, ends = batch.column(width + 1).to_pylist(), [*at[1:].tolist(), batch.num_rows]
            pieces = [between.join(texts[a:b]) for a, b in zip(at.tolist(), ends)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at)) for k in range(width + 1)), pa.array(pieces, pa.string())], names=[*key, place, "piece"])

    pieces = dealt.mapInArrow(joined, f"{keys}, {place} {kinds[place]}, piece string")
    pieces = pieces.repartition(*key).sortWithinPartitions(*key, place)

    def hashed(batches):
        last, state = None, None
        for batch in batches:
            rows = []
            for *now, piece in zip(*(batch.column(k).to_pylist() for k in range(width)), batch.column(width + 1).to_pylist()):
                if now == last:
                    state.update(mark)
                else:
                    if last is not None:
                        rows.append((*last, state.hexdigest()))
                    last, state = now, hashlib.sha256()
                state.update(piece.encode())
            if rows:
                yield _batch(rows, batch, key)
        if last is not None:
            yield _batch([(*last, state.hexdigest())], batch, key)

    return pieces.mapInArrow(hashed, f"{keys}, sha256 string")


def _batch(rows: list[tuple], like: pa.RecordBatch, key: list[str]) -> pa.RecordBatch:
    kinds = [*(like.column(k).type for k in range(len(key))), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[*key, "sha256"])
