"""Cleaning and normalising of descriptions, units, prices and units of measure, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

_SPACE = r"(?U)\s+"
_EDGES = r"(?U)^\s+|\s+$"


def squeezed(text: Column) -> Column:
    """Trimmed, upper-cased, white space runs as one space."""
    return F.regexp_replace(F.upper(F.regexp_replace(text.cast("string"), _EDGES, "")), _SPACE, " ")


def clean_unit(unit: Column) -> Column:
    """An owner's name in one form; placeholders and null are UNSPECIFIED."""
    text = squeezed(unit)
    return F.when(unit.isNull() | text.isin(*C.PLACEHOLDERS), C.UNSPECIFIED).otherwise(text)


def parse_price(price: Column) -> Column:
    """All but digits, points and minus signs goes; what isn't a number then is null."""
    return F.regexp_replace(price.cast("string"), r"[^0-9.\-]", "").try_cast("double")


def is_junk(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, _EDGES, "")).isin(*C.PLACEHOLDERS)


def normalization_steps(text: Column) -> list[tuple[str, Column]]:
    """The normalisation after each of its steps, by name."""
    steps = [("base", squeezed(text))]
    for pattern, full in C.NORMALIZATION_RULES:
        steps.append((full, F.regexp_replace(steps[-1][1], pattern, full)))
    steps.append(("separators", F.regexp_replace(F.regexp_replace(F.regexp_replace(steps[-1][1], r"[,;:/]+", " "), _SPACE, " "), _EDGES, "")))
    return steps


def normalize(text: Column) -> Column:
    return normalization_steps(text)[-1][1]


def trace(text: Column) -> Column:
    """The steps that changed a text: step, before, after."""
    steps = [("source", text), *normalization_steps(text)]
    cells = [F.struct(F.lit(name).alias("step"), before.alias("before"), after.alias("after")) for (_, before), (name, after) in zip(steps, steps[1:])]
    return F.filter(F.array(*cells), lambda s: s["before"] != s["after"])


def uom_cleaned(raw: Column) -> Column:
    """A unit of measure as written, upper-cased, without separators, quotes, brackets and marks at its ends."""
    text = F.regexp_replace(F.upper(F.regexp_replace(F.coalesce(raw.cast("string"), F.lit("")), _EDGES, "")), r"(?U)[\s._\-/\\]+", "")
    return F.regexp_replace(F.regexp_replace(text, r"['()]", ""), r"^[#!]+|[#!]+$", "")


def uom(raw: Column) -> Column:
    """A unit of measure as struct (canonical, dimension); what isn't known stays as it is, dimension unknown."""
    text = uom_cleaned(raw)
    table = F.create_map(*[F.lit(x) for dim, unit, names in C.UOM_TABLE for name in dict.fromkeys([*names.split(), unit]) for x in (name, f"{unit}|{dim}")])
    find = lambda key: F.try_element_at(table, key)
    singular = lambda key: F.when(key.endswith("S"), F.left(key, F.char_length(key) - 1))
    bare = F.regexp_replace(text, r"^\d+", "")
    changed = F.when((bare != "") & (bare != text), bare)
    hit = F.coalesce(find(text), find(F.when(F.char_length(text) > 2, singular(text))), find(changed), find(singular(changed)), F.concat(text, F.lit(f"|{C.UNKNOWN}")))
    hit = F.when(text.isin(*C.UOM_BLANKS), f"{C.UNSPECIFIED}|{C.UNKNOWN}").otherwise(hit)
    return F.struct(F.substring_index(hit, "|", 1).alias("canonical"), F.substring_index(hit, "|", -1).alias("dimension"))


def dimension_of(canonical: Column) -> Column:
    """The dimension of a canonical unit; unknown for any other."""
    known = {unit: dim for dim, unit, _ in C.UOM_TABLE}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), F.upper(canonical)), F.lit(C.UNKNOWN))


def comparable(a: Column, b: Column) -> Column:
    """Whether prices in two canonical units stand beside each other: only in the same unit, as nothing is converted."""
    return F.upper(a) == F.upper(b)


def stripped(text: Column) -> Column:
    """White space runs as one space, control characters as spaces, none at the ends."""
    one = F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, " ")
    return F.regexp_replace(F.regexp_replace(one, r"[\x00-\x1f\x7f]", " "), _EDGES, "")


def confidence(score: Column) -> Column:
    return F.when(score >= C.HIGH_CONFIDENCE, "HIGH").when(score >= C.MEDIUM_CONFIDENCE, "MEDIUM").otherwise("LOW")


def status(mean: Column) -> Column:
    out = F.when(mean >= C.STATUS_BANDS[0][1], C.STATUS_BANDS[0][0])
    for name, floor in C.STATUS_BANDS[1:]:
        out = out.when(mean >= floor, name)
    return out.otherwise(C.FALLBACK_STATUS)
