import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kinfold.llm import queries, simhash
from kinfold.llm.components import components


def plain_fingerprint(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] * bool(word)
            word = ""
        else:
            word += c
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes_of(pairs):
    """Smallest doc_id reachable for (doc_id, fingerprint) rows, by all pairs."""
    fps = np.array([f for _, f in pairs], np.uint64)
    left, out = set(range(len(pairs))), {}
    while left:
        front = [left.pop()]
        group = set(front)
        while front:
            i = front.pop()
            near = {j for j in left if int(fps[i] ^ fps[j]).bit_count() <= 3}
            left -= near
            group |= near
            front += near
        root = min(pairs[i][0] for i in group)
        out |= {pairs[i][0]: root for i in group}
    return out


def test_op8_whole_table(spark, sf):
    rows = queries.op8_simhash_pigeonhole(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {d["doc_id"]: plain_fingerprint(d["text"]) for d in docs}
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in rows} == want and all(len(r["fingerprint"]) == 16 for r in rows)
    assert {r["doc_id"]: r["component_id"] for r in rows} == classes_of(list(want.items()))


def test_links_connect_a_crowded_group(spark, monkeypatch):
    """A group of near fingerprints far over the limit is split until it fits, without losing a link."""
    monkeypatch.setattr(simhash, "LIMIT", 16)
    rng = random.Random(11)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 500:
        fps.add(rng.choice(sorted(fps)[:40]) ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(64) if rng.random() < 0.3 else 0))
    fps |= {rng.getrandbits(64) for _ in range(300)}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    roots = {r["node"]: r["root"] for r in components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()}
    want = classes_of([(s, f) for s, f in zip(signed, fps)])
    assert {f: roots.get(f, f) for f in signed} == want


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 299)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 299: 299, 300: 299}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_documents(spark, odd_docs, no_docs):
    rows = simhash.classes(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[0]["component_id"] == by_id[1]["component_id"] == 0
    assert by_id[2]["fp"] == by_id[3]["fp"] == 0 and by_id[3]["component_id"] == 2
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {0, 2, 5, 6, 7} <= set(ids) and not {1, 3} & set(ids)
    assert simhash.keep_one(no_docs).count() == 0 and simhash.classes(no_docs).count() == 0


@pytest.mark.parametrize("marked", [0, 300_000])
def test_keep_one_with_repeated_rows_and_either_join(spark, monkeypatch, marked):
    monkeypatch.setattr(simhash, "MARKED", marked)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    text = lambda k: " ".join(words[(k * j + j * j) % 10] + str(k * j % 7) for j in range(1, 30))
    rows = [(i, text(i % 12), "b") for i in range(40)] + [(3, text(3), "a")] * 3 + [(None, text(30), "c")] * 2 + [(50, None, "d"), (51, "", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    found = {r["row_key"]: r["root"] for r in simhash.classes(docs).collect()}
    got = sorted(map(str, simhash.keep_one(docs).collect()))
    assert len(got) == len(set(found.values())) and sum("lang='a'" in g for g in got) == 1
    assert not any("doc_id=51" in g or "doc_id=20" in g for g in got) and sum("doc_id=None" in g for g in got) == 1


def test_keep_one_keeps_one_row_of_each_class(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = simhash.classes(docs).agg(F.countDistinct("component_id")).first()[0]
    assert simhash.keep_one(docs).count() == n


def test_keep_one_tells_classes_with_one_id_apart(spark):
    """Unrelated texts without ids, or under one id that repeats, are classes of their own."""
    texts = [" ".join(f"{w}{i}" for i in range(40)) for w in ("ash", "birch", "cedar", "elm", "fir")]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (None, texts[0]), (8, texts[4])]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted((i or 0, t) for i, t in rows[:5])
