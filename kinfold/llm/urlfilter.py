"""URL filter: host rules, then logistic regression on hashed character n-grams.

Scoring uses built-in functions only.  N-grams of the host and of the path are
hashed to ``BUCKETS`` by the first digits of their MD5, so the weights are one
array of a fixed size, whatever the tables hold.  Training runs on a small
labelled URL table, of at most ``TRAIN_ROWS`` rows; the default one is in
``urllabels``.

A null url, or one without ``://``, has an empty host and path, which the
default model allows.  Repeated rows are judged each; of rules of one length
the first in the alphabet wins, of equal ones allow; a score of exactly even odds allows.  An empty
table gives an empty answer.  Extra columns go.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import urllabels
from .common import LOWER, UPPER

#: MD5 digits that number a bucket, and how many buckets they give.
DIGITS, BUCKETS = 3, 4096
GRAMS = (3, 4, 5)
#: Passes over the labelled table, the step, the pull to zero, and a stride that mixes the rows (a prime above TRAIN_ROWS).
TRAIN_ROWS, STEPS, RATE, DECAY, STRIDE = 10_000, 12, 0.25, 1e-3, 10_007
#: What of a host the model doesn't see: endings and the usual beginnings tell little, and would be learned as if they did.
ENDING = r"^(?:www|m)\.|\.[^.]*$"
#: Rules (verdict, host, path) up to which each is a branch of one expression; more are joined.
BRANCHES = 100

# The contract's rules (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest of a few rules that fits, as a struct (rule, verdict); null without one."""
    found = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def grams_of(host: str, path: str) -> list[int]:
    """Buckets of the n-grams of ``^host$``, without ENDING, and ``^path$``, the two kept apart by a leading letter."""
    out = []
    for kind, part in (("h", f"^{re.sub(ENDING, '', host)}$"), ("p", f"^{path}$")):
        for n in GRAMS:
            out += [int(hashlib.md5((kind + part[i : i + n]).encode()).hexdigest()[:DIGITS], 16) for i in range(len(part) - n + 1)]
    return out


def split_url(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest[: min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))]
    path = rest[len(host) :]
    return host.translate(str.maketrans(UPPER, LOWER)), path[: min((i for i in map(path.find, "?#") if i >= 0), default=len(path))]


def train(rows: Sequence[tuple[str, int]]) -> list[float]:
    """Weights of the buckets, then the bias, by gradient descent with a step of its own for each weight.

    A text's n-grams count with weight 1 / the root of their number.  Both labels weigh alike, however many rows each has.
    """
    if len(rows) > TRAIN_ROWS:
        raise ValueError(f"the labelled table has {TRAIN_ROWS} rows at most")
    n = Counter(label for _, label in rows)
    share = {label: len(rows) / (len(n) * count) for label, count in n.items()}
    known = []
    for url, label in rows:
        grams = Counter(grams_of(*split_url(url)))
        norm = math.sqrt(max(sum(grams.values()), 1))
        known.append(([*((g, k / norm) for g, k in sorted(grams.items())), (BUCKETS, 1.0)], label))
    weights, seen = [0.0] * (BUCKETS + 1), [1e-2] * (BUCKETS + 1)
    for step in range(STEPS):
        for i in range(len(known)):
            grams, label = known[i * STRIDE % len(known)]
            z = sum(weights[g] * v for g, v in grams)
            miss = share[label] * (1 / (1 + math.exp(-max(-700, min(700, z)))) - label)
            for g, v in grams:
                slope = miss * v + DECAY * weights[g]
                seen[g] += slope * slope
                weights[g] -= RATE * slope / math.sqrt(seen[g])
    return [round(w, 9) for w in weights]


@lru_cache(maxsize=1)
def default_weights() -> list[float]:
    """Weights from the labelled table of ``urllabels``."""
    return train(urllabels.labelled())


def train_table(labelled: DataFrame) -> list[float]:
    """Weights from a table (url, label) of at most TRAIN_ROWS rows."""
    rows = labelled.select("url", "label").filter("label is not null").limit(TRAIN_ROWS + 1).collect()
    return train(sorted((r["url"] or "", int(r["label"])) for r in rows))


def logit(host: Column, path: Column, weights: Sequence[float]) -> Column:
    """The model's log odds of block, from built-in functions."""
    table = F.from_json(F.lit(json.dumps(list(weights[:BUCKETS]))), "array<double>")

    def bucket(gram: Column) -> Column:
        return F.conv(F.substring(F.md5(gram.cast("binary")), 1, DIGITS), 16, 10).cast("int")

    def buckets(kind: str, part: Column) -> Column:
        chars = F.regexp_extract_all(F.concat(F.lit("^"), part, F.lit("$")), F.lit("(?s)."), F.lit(0))
        # Each character beside those that follow it, so that the time is linear in the length.
        runs = F.arrays_zip(*[F.slice(chars, 1 + i, F.lit(1 << 30)).alias(f"c{i}") for i in range(max(GRAMS))])
        some = F.transform(runs, lambda r: F.array(*[F.concat(F.lit(kind), *[r[f"c{i}"] for i in range(n)]) for n in GRAMS]))
        return F.transform(F.filter(F.flatten(some), lambda g: g.isNotNull()), bucket)

    grams = F.concat(buckets("h", F.regexp_replace(host, ENDING, "")), buckets("p", path))
    total = F.aggregate(grams, F.lit(0.0), lambda acc, g: acc + F.get(table, g))
    return F.lit(float(weights[BUCKETS])) + total / F.sqrt(F.greatest(F.size(grams), F.lit(1)).cast("double"))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def with_rules(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """``parts`` (with host and path) and found (rule, verdict): the longest of any number of rules (verdict, host, path) that fits.

    A host meets the rules of each of its suffixes once, however many urls it
    has.  Its rules, longest first, are then tried on each url's path.
    """
    known = rules.select("verdict", F.col("host").alias("suffix"), F.col("path").alias("start")).distinct()
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.lit(1 << 30)), "."))
    hosts = parts.select("host").distinct().select("host", F.explode(suffixes).alias("suffix"))
    rule = F.concat("suffix", "start")
    met = hosts.join(known, "suffix").select("host", F.struct((-F.char_length(rule)).alias("less"), rule.alias("rule"), "verdict", "start").alias("r"))
    per = met.groupBy("host").agg(F.array_sort(F.collect_list("r")).alias("rules"))  # the rules of one host's suffixes
    first = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["start"])), F.lit(0))
    return parts.join(per, "host", "left").withColumn("found", F.when(first.isNotNull(), F.struct(first["rule"].alias("rule"), first["verdict"].alias("verdict")))).drop("rules")


def judge(pages: DataFrame, weights: Sequence[float] | None = None, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of each url.  Rules are a list, or a table (verdict, host, path) of any size."""
    weights = weights or default_weights()
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if isinstance(rules, DataFrame):
        found = with_rules(parts, rules)
    elif len(rules) > BRANCHES:
        found = with_rules(parts, rule_table(pages.sparkSession, rules))
    else:
        found = parts.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    model = F.when(logit(F.col("host"), F.col("path"), weights) > 0, "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", model).alias("verdict"))


def verdict_sql(weights: Sequence[float] | None = None) -> str:
    """DuckDB SQL for ``judge`` over ``pages`` with the contract's rules."""
    weights = weights or default_weights()
    grams = []
    for kind, part in (("h", "stem"), ("p", "path")):
        for n in GRAMS:
            grams.append(f"list_transform(range(1, length({part}) + 4 - {n}), lambda i: '{kind}' || substr('^' || {part} || '$', i, {n}))")
    cases = [
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'rule': '{h + p}', 'verdict': '{v}'}}"
        for v, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    ]
    return f"""
WITH w AS (SELECT {list(weights[:BUCKETS])}::DOUBLE[] AS weights),
r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
u AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
t AS (SELECT *, regexp_replace(host, '{ENDING}', '', 'g') AS stem FROM u),
g AS (SELECT *, list_concat({', '.join(grams[:3])}) AS a, list_concat({', '.join(grams[3:])}) AS b FROM t),
s AS (SELECT page_id, host, path, list_concat(a, b) AS grams FROM g),
z AS (SELECT page_id, host, path, {float(weights[BUCKETS])!r} + coalesce(list_sum(list_transform(grams, lambda x: weights[1 + ('0x' || md5(x)[1:{DIGITS}])::INT])), 0)
             / sqrt(greatest(len(grams), 1)) AS z FROM s, w),
f AS (SELECT *, CASE {' '.join(cases)} END AS found FROM z)
SELECT page_id, host, path, found.rule AS rule, coalesce(found.verdict, CASE WHEN z > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM f
"""
