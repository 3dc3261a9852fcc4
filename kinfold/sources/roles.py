"""Which column plays which role, from what columns are called and what they hold."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C

_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity)\s*$"

@dataclass(frozen=True)
class Profile:
    """Shares are of the filled cells, trimmed; ``rows`` counts all rows."""

    rows: int
    n: int
    mean_len: float
    distinct: float
    numeric: float
    spaces: float
    uom: float
    positive: float
    fractional: float


@dataclass(frozen=True)
class Choice:
    column: str
    how: str


def profiles(table: DataFrame) -> dict[str, Profile]:
    """The profile of every column of the whole table.

    Distinct values are counted exactly, in two steps: values are made distinct
    by column, before and after a shuffle, then counted.  Both answers are a row
    for each column at most, however long the table.
    """
    if not table.columns:
        return {}
    cells, texts = [], []
    for name in table.columns:
        text = F.trim(F.col(f"`{name}`").cast("string"))
        text = F.when(text != "", text)
        texts.append(text)
        bare = F.replace(text, F.lit(","), F.lit(""))
        number = F.when(bare.rlike("(?i)" + _NUMBER), bare.try_cast("double"))
        share = lambda test, of: F.coalesce(F.count_if(test) / F.when(F.count(of) > 0, F.count(of)), F.lit(0.0))
        cells.append(
            F.struct(
                F.count(F.lit(1)).alias("rows"), F.count(text).alias("n"), F.coalesce(F.avg(F.char_length(text)), F.lit(0.0)).alias("mean_len"),
                share(number.isNotNull(), text).alias("numeric"), share(text.contains(" "), text).alias("spaces"), share(F.upper(text).isin(*C.UOM_CELLS), text).alias("uom"),
                share(number > 0, number).alias("positive"), share(number % 1 != 0, number).alias("fractional"),
            )
        )
    row = table.agg(*[cell.alias(f"c{i}") for i, cell in enumerate(cells)]).first()
    each = table.select(F.posexplode(F.array(*texts)).alias("i", "t")).filter("t IS NOT NULL").distinct().groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    values = {r["i"]: r["n"] for r in each.collect()}  # a row for each column
    return {name: Profile(distinct=values.get(i, 0) / max(row[i]["n"], 1), **row[i].asDict()) for i, name in enumerate(table.columns)}


def named(columns: list[str], role: str) -> str | None:
    """The first of a role's own names that a column bears, whatever its case; of columns that share a name the last."""
    by_name = {c.strip().lower(): c for c in columns}
    return next((by_name[n.lower()] for n in C.ROLE_NAMES[role] if n.lower() in by_name), None)


def name_weight(column: str, role: str) -> float:
    """The heaviest of a role's words found in a column's name, with or without its spaces."""
    spaced = re.sub(r"[_\-]+", " ", column.strip().lower())
    tight = spaced.replace(" ", "")
    return max((w for word, w in C.ROLE_TOKENS[role].items() if word in spaced or word.replace(" ", "") in tight), default=0.0)


def _prose(p: Profile) -> float:
    return 2.2 * min(p.mean_len / 18, 2) + 2.4 * p.distinct + 2 * p.spaces


@dataclass(frozen=True)
class Rule:
    """A column may play a role if ``allows`` it; of those the greatest of name weight plus ``content`` plays it."""

    least_name: float
    content: Callable[[Profile], float]
    allows: Callable[[Profile, float], bool]  # of the profile and its content score
    weight_of_name: float = 1.0


RULES = {
    "description": Rule(1.0, lambda p: _prose(p) - 5 * p.numeric - 6 * p.uom, lambda p, content: content >= 1.2),
    "unit": Rule(
        2.0,
        lambda p: (2.5 if p.distinct < 0.05 else 1.2 if p.distinct < 0.2 else -1.5) + (1 if p.mean_len <= 24 else -1) - 2.5 * p.numeric,
        lambda p, content: content > 0 and p.uom <= 0.35,
    ),
    "code": Rule(1.5, lambda p: 3 * p.distinct + (1.2 if p.mean_len <= 24 else -1.5) - 1.5 * p.spaces, lambda p, content: p.distinct >= 0.4),
    "price": Rule(
        2.0,
        lambda p: 3 * p.numeric + 2 * p.positive + 1.5 * p.fractional + (0.8 if p.distinct > 0.3 else 0),
        lambda p, content: p.numeric >= 0.8 and p.positive >= 0.8,
    ),
    "measure": Rule(0.0, lambda p: 6 * p.uom, lambda p, content: p.uom >= 0.45 and p.mean_len <= 12 and p.distinct <= 0.25),
}


def _best(known: dict[str, Profile], role: str, taken: set[str]) -> str | None:
    """The column with the greatest score above zero; the first of equals."""
    rule, scores = RULES[role], {}
    for column, p in known.items():
        weight = name_weight(column, role)
        if column not in taken and p.n and weight >= rule.least_name and rule.allows(p, content := rule.content(p)):
            scores[column] = weight + content
    found = max(scores, key=scores.get, default=None)
    return found if found is not None and scores[found] > 0 else None


def _only_prose(known: dict[str, Profile]) -> str | None:
    """The one column of free text, or one that stands half as high again as the next."""
    texts = [(_prose(p), c) for c, p in known.items() if p.n and p.mean_len >= 8 and p.numeric <= 0.2 and p.uom <= 0.2 and p.spaces >= 0.2 and p.distinct >= 0.005]
    texts.sort(reverse=True)
    return texts[0][1] if len(texts) == 1 or (texts and texts[0][0] > 1.5 * texts[1][0]) else None


def label_of(known: dict[str, Profile], taken: set[str]) -> Choice | None:
    """The column of known groups, if one is called that and holds groups."""
    scores = {}
    for column, p in known.items():
        text = re.sub(r"[^a-z0-9 ]+", " ", column.strip().lower()).strip()
        weight = max((w for word, w in C.ROLE_TOKENS["label"].items() if word in text), default=0.0)
        coverage, groups = p.n / max(p.rows, 1), round(p.distinct * p.n)
        if column not in taken and weight and coverage >= C.LABEL_MIN_COVERAGE and groups >= C.LABEL_MIN_GROUPS and p.distinct <= C.LABEL_MAX_DISTINCT:
            scores[column] = weight + 2 * (1 - abs(0.35 - p.distinct)) + coverage
    best = max(scores, key=scores.get, default=None)
    return Choice(best, f"about {round(known[best].distinct * known[best].n)} groups over {known[best].n} rows") if best else None


def notes(spark: SparkSession, chosen: dict[str, Choice]) -> DataFrame:
    """role, column, reason of the roles inferred, in the order of RULES."""
    rows = [(role, c.column, f"{c.column} was taken for the {role}: {c.how}") for role, c in chosen.items()]
    return spark.createDataFrame(rows, "role string, column string, reason string")


def infer(known: dict[str, Profile]) -> dict[str, Choice]:
    """role -> column and why, for the roles that a column was found for."""
    chosen: dict[str, Choice] = {}
    for role in RULES:
        column = named(list(known), role) if role in C.ROLE_NAMES else None
        if role == "unit" and column is not None and known[column].uom > 0.5:
            column = None  # called a unit, holds units of measure
        how = "a known name"
        if column is None:
            column, how = _best(known, role, {c.column for c in chosen.values()}), "its name and what it holds"
        if column is None and role == "description":
            column, how = _only_prose(known), "the only column of free text"
        if column is not None:
            chosen[role] = Choice(column, how)
    label = label_of(known, {c.column for c in chosen.values()})
    return {**chosen, "label": label} if label else chosen
