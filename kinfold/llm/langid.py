"""Language identification with hyperdimensional profiles.

Each letter has a random vector of signs.  An n-gram's vector binds (multiplies)
its letters' vectors, each permuted (rotated) by its place.  A text's profile
bundles (adds) the vectors of all its n-grams; a language's prototype bundles
the unit profiles of its training texts.  A text gets the language whose
prototype has the largest cosine with its profile; ties go to the smaller name.

Only letters matter: case is folded, and each run of other characters is one
space.  A text that is null or has no letter gets ``und`` and score 0.  Long
texts are read whole.

Training takes every labelled row, or, where a language has more than
``TRAIN_ROWS`` of them, a share of them chosen by a hash of the id so that
about that many are expected.  Rows with null text or language don't train.
Rows that repeat a doc_id train and are judged each.  Without prototypes every
text gets ``und``; an empty table gives an empty answer.  Other columns are
left out.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

DIMENSIONS, ORDER, SEED = 1024, 3, 20
#: Expected training rows of each language at most.
TRAIN_ROWS = 5000
#: N-gram vectors a worker keeps, and how many are gathered at once.
MEMO, STEP = 20_000, 2_048


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=100_000)
def _letter_vector(code: int) -> np.ndarray:
    return np.random.default_rng((SEED, code)).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1


def _bound(keys: np.ndarray) -> np.ndarray:
    """The vectors of n-grams given as 21-bit letters packed in an integer."""
    out = np.ones((len(keys), DIMENSIONS), np.int8)
    for place in range(ORDER):
        codes, back = np.unique((keys >> (21 * place)) & 0x1FFFFF, return_inverse=True)
        out *= np.stack([np.roll(_letter_vector(int(c)), place) for c in codes])[back]
    return out


class _Vectors:
    """N-gram vectors met by a worker, sorted by key."""

    def __init__(self):
        self.keys, self.rows, self.table = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, DIMENSIONS), np.int8)

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        if known.all():
            return self.table[self.rows[at]]
        fresh = keys[~known]
        made = _bound(fresh)
        out = np.empty((len(keys), DIMENSIONS), np.int8)
        out[known], out[~known] = self.table[self.rows[at[known]]], made
        if len(self.keys) + len(fresh) <= MEMO:
            merged = np.concatenate([self.keys, fresh])
            order = np.argsort(merged, kind="stable")
            self.rows = np.concatenate([self.rows, np.arange(len(self.table), len(self.table) + len(fresh))])[order]
            self.keys, self.table = merged[order], np.concatenate([self.table, made])
        return out


_VECTORS = _Vectors()


def profile(text: str | None) -> np.ndarray | None:
    """The unit profile of a text; None without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32)
    codes = np.concatenate([[32], codes[letter | np.concatenate([[True], letter[:-1]])], [32]])
    spaces = codes == 32
    codes = codes[~(spaces & np.concatenate([[False], spaces[:-1]]))]
    grams = codes[:-2] | codes[1:-1] << 21 | codes[2:] << 42
    keys, counts = np.unique(grams, return_counts=True)
    total = np.zeros(DIMENSIONS, np.float32)
    for i in range(0, len(keys), STEP):
        total += counts[i : i + STEP].astype(np.float32) @ _VECTORS.of(keys[i : i + STEP]).astype(np.float32)
    norm = float(np.linalg.norm(total))
    return total / norm if norm else total


def train(docs: DataFrame, train_on: Column, rows: int = TRAIN_ROWS) -> dict[str, np.ndarray]:
    """Language -> unit prototype.  One row per language reaches the driver."""
    prepare(docs.sparkSession)
    fit = docs.filter(train_on & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in fit.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    shares = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, rows / n))])
    fit = fit.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.try_element_at(shares, F.col("lang")) * 1_000_003)

    def run(frames):
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"]):
                if (p := profile(text)) is not None:
                    sums[lang] = sums[lang] + p if lang in sums else p.astype(float)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [v.tolist() for v in sums.values()]})

    parts = fit.select("lang", "text").mapInPandas(run, "lang string, v array<double>")
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).collect()  # a row of fixed size for each language
    out = {r["lang"]: np.array([c["x"] for c in r["v"]]) for r in found}
    return {lang: (v / (np.linalg.norm(v) or 1)).astype(np.float32) for lang, v in sorted(out.items())}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score (the cosine, 0 at least) of each document."""
    prepare(docs.sparkSession)
    names, table = list(prototypes), np.stack(list(prototypes.values())) if prototypes else None

    def judge(text):
        if table is None or (p := profile(text)) is None:
            return "und", 0.0
        cosines = table @ p
        best = int(np.argmax(cosines))
        return names[best], float(min(1.0, max(0.0, cosines[best])))

    def run(frames):
        for frame in frames:
            rows = [judge(t) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double")
