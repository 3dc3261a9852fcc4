"""Proposed codes: a class word found in the corpus, and a number within the class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .ranking import ranked


def tokens(text: Column) -> Column:
    """The words of a text that may name a class, in order."""
    words = F.split(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9]+")
    size = r"^[0-9]|[0-9]{2,}|^M[0-9]|X[0-9]"
    return F.filter(words, lambda w: (F.char_length(w) >= 2) & ~w.isin(*C.CODE_STOPWORDS, *C.CODE_MODIFIERS) & ~w.rlike(size))


def slug(word: Column) -> Column:
    """At most five characters of a word; longer ones lose the vowels after their first letter."""
    short = F.left(F.concat(F.left(word, F.lit(1)), F.regexp_replace(F.substring(word, 2, 1 << 20), "[AEIOU]", "")), F.lit(C.CODE_SLUG))
    return F.when(F.char_length(word) <= C.CODE_SLUG, word).when(F.char_length(short) < 2, F.left(word, F.lit(C.CODE_SLUG))).otherwise(short)


def propose(families: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """family_no, category, proposed_code of families (family_no, golden).

    The class is the first word of the family's item (family_no, item), where a
    model has named one, else the first word that two families share, else the
    first word, else GEN.  Numbers follow the golden text, so a re-run gives the
    same codes.
    """
    words = families.select("family_no", F.posexplode(tokens(F.col("golden"))).alias("pos", "word"))
    shared = words.groupBy("word").agg(F.countDistinct("family_no").alias("n_families"))
    known = words.join(shared, "word")
    picked = known.groupBy("family_no").agg(F.min_by("word", F.struct(F.col("n_families") < C.CODE_MIN_FAMILIES, F.col("pos"))).alias("word"))
    named = families.select("family_no", "golden").join(picked, "family_no", "left")
    if items is not None:
        item = F.upper(F.get(F.split(F.trim(F.regexp_replace("item", r"(?U)\s+", " ")), " "), F.lit(0)))
        told = items.select("family_no", item.alias("own")).filter("own <> ''").groupBy("family_no").agg(F.min("own").alias("own"))
        named = named.join(told, "family_no", "left").withColumn("word", F.coalesce("own", "word")).drop("own")
    named = named.withColumn("category", F.coalesce(slug(F.col("word")), F.lit(C.CODE_FALLBACK)))
    # A class may hold most families: places in the order of all classes, less those of the classes before.
    every = ranked(named, [F.col("category"), F.upper("golden"), F.col("family_no")], "at")
    every = every.join(every.groupBy("category").agg(F.min("at").alias("first")), "category")
    place = F.col("at") - F.col("first") + 1
    digits = F.when(place < 10000, F.lpad(place.cast("string"), 4, "0")).otherwise(place.cast("string"))
    return every.select("family_no", "category", F.concat_ws("-", F.lit(C.CODE_PREFIX), "category", digits).alias("proposed_code"))
