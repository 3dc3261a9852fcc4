"""Quality of documents by a regularised quadratic discriminant.

Each text gives a vector of statistics of its characters, words and lines,
transformed to be close to normal.  Each class has a mean and a covariance
that is shrunk towards the pooled one and towards a multiple of the identity.
The score is the logistic of the difference of the classes' log densities,
from Mahalanobis distances with the Cholesky factors found once at fitting.

Sums over all labelled rows fit the model: one aggregate, whose result has two
rows whatever the corpus.  Only the text is looked at.

Null text counts as empty and is scored like any text.  A document without a
label, with a null label or a null doc_id doesn't train.  Labels that repeat a
doc_id train with their mean, 0.5 up counting as 1.  Without rows of both
classes every score is 0.5.  Rows that repeat a doc_id are judged each, and
train each; equal texts have equal scores.  An empty table gives an empty
answer.  Other columns are left out by ``judge`` and kept by ``reject``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, settle

NAMES = [
    "chars", "word", "longest", "upper", "digit", "mark", "symbol", "bar", "shout", "newline", "wide", "fresh_words", "fresh_lines", "odd_ends",
]
FIELDS = [f"f_{n}" for n in NAMES]
#: Shrinkage towards the pooled covariance and the identity, and the divisor that tempers the densities of features which aren't independent.
POOL, RIDGE, TEMPER = 0.3, 0.1, 4.0

_KINDS = np.zeros(256, np.uint8)  # 0 lower-case letters and the rest of ASCII
_KINDS[65:91] = 1
_KINDS[48:58] = 2
for _c in b".,;:'\"()-?":
    _KINDS[_c] = 3
for _c in b"#$%&*+/<=>@[\\]^_`{}~":
    _KINDS[_c] = 4
_KINDS[ord("|")] = 5
_KINDS[ord("!")] = 6
_KINDS[10] = 7
for _c in (9, 11, 12, 13, 32):
    _KINDS[_c] = 8
_KINDS[192:] = 9  # first bytes of longer characters
_KINDS[128:192] = 10  # and their other bytes


def statistics(text: str) -> list[float]:
    """The transformed statistics of a text, in the order of NAMES."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    k = np.bincount(_KINDS[raw], minlength=11)
    n = max(len(text), 1)
    words, lines = text.split(), text.split("\n")
    n_words = max(len(words), 1)
    ratio = lambda x: float(np.log(x + 1e-3))
    ends = sum(not w[-1].isalnum() and w[-1] not in ".,;:" for w in words)
    return [
        float(np.log1p(len(text))),
        float(np.log1p(len(text) / n_words)),
        float(np.log1p(max(map(len, words), default=0))),
        *(ratio(k[i] / n) for i in (1, 2, 3, 4, 5, 6, 7, 9)),
        float(np.log1p(len(set(words)))) - float(np.log1p(len(words))),
        ratio(len(set(lines)) / len(lines)),
        ratio(ends / n_words),
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each document."""
    prepare(docs.sparkSession)

    def run(frames):
        for frame in frames:
            rows = [statistics(t or "") for t in frame["text"].where(frame["text"].notna(), None)]
            yield pd.concat([frame[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=FIELDS, dtype=float)], axis=1)

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, " + ", ".join(f"{f} double" for f in FIELDS))


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors and log determinants of the two classes; prior is the log odds of class 1."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = [((x - self.means[c]) @ self.factors[c].T) for c in (0, 1)]
        density = [-0.5 * ((v * v).sum(axis=1) + self.log_dets[c]) for c, v in enumerate(z)]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0] + self.prior) / TEMPER, -700, 700)))


def fit(rows: DataFrame, label: str = "label") -> Model | None:
    """The model of labelled statistics; None without both classes.  Covariances come from exact sums."""
    p = len(FIELDS)
    cells = [F.count(F.lit(1)).alias("n"), *(F.sum(f).alias(f"s{i}") for i, f in enumerate(FIELDS))]
    cells += [F.sum(F.col(FIELDS[i]) * F.col(FIELDS[j])).alias(f"q{i}_{j}") for i in range(p) for j in range(i, p)]
    got = {r[label]: r for r in rows.groupBy(label).agg(*cells).collect()}  # two rows
    if set(got) != {0, 1}:
        return None
    counts = np.array([got[c]["n"] for c in (0, 1)], float)
    means = np.array([[got[c][f"s{i}"] / got[c]["n"] for i in range(p)] for c in (0, 1)])
    covs = np.array([[[got[c][f"q{min(i, j)}_{max(i, j)}"] / got[c]["n"] for j in range(p)] for i in range(p)] for c in (0, 1)])
    covs -= means[:, :, None] * means[:, None, :]
    return shrunk(counts, means, covs)


def shrunk(counts: np.ndarray, means: np.ndarray, covs: np.ndarray) -> Model:
    """The model of class counts, means and covariances after shrinkage on the scale of the pooled deviations."""
    pooled = np.tensordot(counts / counts.sum(), covs, 1)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    outer = scale[:, None] * scale[None, :]
    eye = np.eye(len(scale))
    factors, dets = [], []
    for c in (0, 1):
        cov = (1 - RIDGE) * ((1 - POOL) * covs[c] + POOL * pooled) / outer + RIDGE * eye
        low = np.linalg.cholesky((cov + cov.T) / 2)
        factors.append(np.linalg.inv(low) / scale[None, :])
        dets.append(2 * np.log(np.diag(low)).sum())
    return Model(means, np.array(factors), np.array(dets), float(np.log(counts[1] / counts[0])))


def scored(rows: DataFrame, model: Model | None) -> DataFrame:
    """Adds ``score`` to rows of statistics."""

    def run(frames):
        for frame in frames:
            x = frame[FIELDS].to_numpy(float)
            frame["score"] = model.score(x) if model else 0.5
            yield frame

    return rows.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", score double")


def training_labels(labels: DataFrame, rows: Column) -> DataFrame:
    """doc_id, label for the label rows that ``rows`` chooses."""
    known = labels.filter(rows & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    return known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))


def judge(docs: DataFrame, labels: DataFrame, train_on: Column, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of each document, by a model of the labelled rows that ``train_on`` chooses."""
    stats = settle(features(docs), "statistics")
    model = fit(stats.join(training_labels(labels, train_on), "doc_id"))
    return scored(stats, model).select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, train_on: Column, threshold: float = 0.3) -> DataFrame:
    """The documents that the classifier accepts, with all their columns; the text is read twice and never shuffled.

    Every row is scored on its own text, so rows that share a doc_id may differ.
    """
    prepare(docs.sparkSession)
    model = fit(features(docs).join(training_labels(labels, train_on), "doc_id"))
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(at).to_pylist()]
            x = np.array([statistics(t) for t in texts], float).reshape(len(texts), len(FIELDS))
            score = model.score(x) if model else np.full(len(texts), 0.5)
            yield batch.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)
