"""The nearest families of many texts against brute force, and how few pairs are looked at."""

import collections
import math
import random

import pytest

from kinfold.operators import probes
from kinfold.operators import similarity as S


def counts(text):
    padded = f" {text} "
    return collections.Counter(padded[i : i + 3] for i in range(max(1, len(padded) - 2)))


def cosine(a, b):
    return sum(n * b[g] for g, n in a.items()) / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))


def plain(asked, known, k):
    out = set()
    for i, text in asked.items():
        near = sorted((-cosine(counts(text), counts(other)), j) for j, other in known.items() if counts(text) & counts(other))[:k]
        out |= {(i, j, place, round(-c, 9)) for place, (c, j) in enumerate(near, 1)}
    return out


def grams(spark, texts):
    return S.trigrams(spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3))


@pytest.mark.parametrize("seed, k", [(1, 1), (2, 3), (3, 6)])
def test_nearest_equals_brute_force(spark, monkeypatch, seed, k):
    monkeypatch.setattr(probes, "CHAMPIONS", 3)
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(2, 7))) for _ in range(25)]
    known = {j: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for j in range(80)}
    known[80], known[81] = known[3], known[3]  # ties
    asked = {i: " ".join([*rng.sample(words, 2), rng.choice(["", "zzz", "abab"])]).strip() for i in range(40)}
    asked |= {100: "", 101: "xyxyxy", 102: known[3]}
    got = {(r["id"], r["other"], r["place"], round(r["cos"], 9)) for r in probes.nearest(grams(spark, asked), grams(spark, known), k).collect()}
    assert got == plain(asked, known, k)


def test_common_grams_are_hardly_read(spark):
    """Every text has the same first word: its grams' lists hold all families, and aren't read."""
    rng = random.Random(4)
    tail = lambda: "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(10))
    known = {j: f"bolt {tail()}" for j in range(400)}
    asked = {i: known[i][:-1] + "y" for i in range(200)}
    found = probes.candidates(grams(spark, asked), grams(spark, known), 1)
    assert found.count() < 200 * 400 / 20
    got = {(r["id"], r["other"]) for r in probes.nearest(grams(spark, asked), grams(spark, known), 1).collect()}
    assert got == {(i, i) for i in asked}


def test_no_probes_and_no_families(spark):
    some, none = grams(spark, {1: "a b"}), grams(spark, {1: "a b"}).limit(0)
    assert probes.nearest(none, some, 2).collect() == [] and probes.nearest(some, none, 2).collect() == []
