"""Records of a delimited file whose cells may hold line breaks, read by splits.

A line that begins outside quotes begins a record; one that begins inside goes
on with a cell.  What a line makes of either is a function of two states, and
such functions can be put together in any grouping.  So each split is run
through once for both states it may begin in, the splits' functions are put
together in order (one small row each), and a second run joins lines to
records.  A record that reaches into the next splits gets their first lines
afterwards; nothing else is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inside_after(line: str, inside: bool, separator: str) -> bool:
    """Whether a line ends inside a quoted cell, if it began inside one or not.

    A quote opens at the beginning of a cell only, two are one, and one that
    neither the separator nor the end follows makes the cell a plain one.
    """
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == '"':
                at += 2
                continue
            inside = False
        elif line[at : at + 1] == '"':
            inside, at = True, at + 1
            continue
        at = line.find(separator, at)
        if at < 0:
            return False
        at += 1


class Split:
    """What is known of a split after a run: for either state it may begin in, the state it ends in and its last record's first row."""

    def __init__(self):
        self.ends, self.last = [False, True], [None, None]

    def add(self, row: int, line: str, separator: str) -> None:
        for k in (0, 1):
            if not self.ends[k]:
                self.last[k] = row
            self.ends[k] = inside_after(line, self.ends[k], separator)


def states(splits: Iterable[tuple[int, list[bool], list[int | None]]]) -> dict[int, tuple[bool, int | None]]:
    """For each split (its place in the file, ends, last) in order: the state it begins in, and the row of the record that is open there."""
    out, inside, owner = {}, False, None
    for place, ends, last in sorted(splits):
        out[place] = inside, owner
        owner = owner if last[inside] is None else last[inside]
        inside = ends[inside]
    return out


class Joiner:
    """Joins the lines of splits, in order, to records."""

    def __init__(self, begin: dict[int, tuple[bool, int | None]], separator: str):
        self.begin, self.separator = begin, separator
        self.place, self.lines, self.inside, self.row, self.away = None, [], False, None, False

    def flush(self) -> list[tuple]:
        """The record so far: its row, whether that is in another split, the split, its text."""
        out = [(self.row, self.away, self.place, "\n".join(self.lines))] if self.lines else []
        self.lines = []
        return out

    def add(self, place: int, row: int, line: str) -> list[tuple]:
        """Take a line; the record that it ends, if any."""
        out = []
        if place != self.place:
            out = self.flush()
            self.place, self.away = place, True
            self.inside, self.row = self.begin[place]
        if not self.inside:
            out += self.flush()
            self.row, self.away = row, False
        self.lines.append(line)
        self.inside = inside_after(line, self.inside, self.separator)
        return out


def records(lines: DataFrame, separator: str) -> DataFrame:
    """_row, value of each record, from the lines (value, _row, _from) of one file as they were read.

    ``_from`` is where a line's split begins in the file, ``_row`` grows in the order of the file.
    A record's row is that of its first line.  A quote that is never closed takes what follows into one record.
    """
    clean = lines.select("_from", "_row", F.regexp_replace("value", "\r$", "").alias("value"))

    def scan(frames):
        found: dict[int, Split] = {}
        for frame in frames:
            for place, row, line in zip(frame["_from"].tolist(), frame["_row"].tolist(), frame["value"]):
                found.setdefault(place, Split()).add(row, line, separator)
        yield pd.DataFrame([(p, s.ends, [-1 if r is None else r for r in s.last]) for p, s in found.items()], columns=["place", "ends", "last"])

    seen = clean.mapInPandas(scan, "place long, ends array<boolean>, last array<long>").collect()  # a row for each split
    begin = states((r["place"], list(r["ends"]), [None if x < 0 else x for x in r["last"]]) for r in seen)

    def join(frames):
        joiner, names = Joiner(begin, separator), ["_row", "away", "_from", "value"]
        for frame in frames:
            yield pd.DataFrame([r for line in zip(frame["_from"].tolist(), frame["_row"].tolist(), frame["value"]) for r in joiner.add(*line)], columns=names)
        yield pd.DataFrame(joiner.flush(), columns=names)

    pieces = clean.mapInPandas(join, "_row long, away boolean, _from long, value string")
    owners = sorted({owner for inside, owner in begin.values() if inside and owner is not None})  # a row for each split at most
    if not owners:
        return pieces.select("_row", "value")
    torn = pieces.filter(F.col("_row").isin(owners)).groupBy("_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_from", "value"))), lambda p: p["value"]), "\n").alias("value"))  # one record's pieces
    return pieces.filter(~F.col("_row").isin(owners)).select("_row", "value").unionByName(torn)
