"""Jaccard join, conversation repair and prefix trie against plain Python."""

import collections
import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinfold.llm import jaccard, queries, repair, shingles, trie
from kinfold.llm.running import digests, running

WHITE = " \t\n\x0b\x0c\r"

# -- operator 11


def plain_set(text, size=4):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    return frozenset(" ".join(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))) if ws else frozenset()


def plain_classes(rows):
    """Per row: set size and the smallest id reachable, by all pairs."""
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    groups = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        groups[top(i)].append(doc_id)
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return [(d, len(s), least[top(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_op11_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.op11_adaptive_prefix_jaccard(spark, sf).select("doc_id", "n_shingles", "component_id").collect()]
    assert ordered(got) == ordered(plain_classes(rows))


@pytest.mark.parametrize("block", [3, 256])
def test_jaccard_of_crowded_families(spark, monkeypatch, block):
    """Families of near copies over many blocks, with pairs on both sides of the threshold and chains of links."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "COLUMNS", 16)
    rng = random.Random(block)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared = [word() for _ in range(30)]
    rows, number = [], 0
    for family in range(4):
        base = [word() for _ in range(rng.choice([12, 60, 150]))] + shared
        for _ in range(25):
            text = base.copy()
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = word()
            rows.append((number, " ".join(text)))
            number += 1
            base = text if rng.random() < 0.4 else base
    rows += [(number + k, " ".join([word() for _ in range(10)] + shared)) for k in range(20)]
    got = [tuple(r) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()]
    assert ordered(got) == ordered(plain_classes(rows))


def test_jaccard_of_odd_documents(spark, odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    assert ordered(tuple(r) for r in jaccard.classes(odd_docs).collect()) == ordered(plain_classes(rows))
    assert jaccard.classes(no_docs).collect() == []


def test_shingle_hashes_tell_sets_apart():
    texts = ["A b\tc\nd e", "a B c d  e", "a b c", "ab c", "a bc", "b a", "", None, " \x0b\x0c ", "e d c b a", "é É x y z w", "w " * 300_000, "x" * 2_000_000]
    column = pa.array(texts)
    got = [frozenset(s.tolist()) for s in shingles.sets(column, 4)]
    want = [plain_set(t) for t in texts]
    assert [len(s) for s in got] == [len(s) for s in want]
    for i in range(len(texts)):
        assert [got[i] == g for g in got] == [want[i] == w for w in want]
    assert [s.tolist() for s in shingles.sets(column.slice(3, 5), 4)] == [sorted(s) for s in got[3:8]]


# -- running values and digests


def test_running_values_of_a_key_over_many_partitions(spark):
    rows = [(k, i, (k * 7 + i) % 13) for k in (1, 2, 3) for i in range(400 if k == 2 else 5)]
    rows = spark.createDataFrame(rows, "k long, i long, v long").repartition(7)
    got = running(rows.withColumn("w", F.col("v")), "k", ["k", "i"], ["k", "i", "v", "w"], {"v": "sum", "w": "xor"}, "test").orderBy("k", "i").collect()
    seen = {}
    for r in got:
        place, total, mixed = seen.get(r["k"], (0, 0, 0))
        seen[r["k"]] = place, total, mixed = place + 1, total + r["v"], mixed ^ r["v"]
        assert (r["place"], r["run_v"], r["run_w"]) == (place, total, mixed)
    every = running(rows, None, ["k", "i"], ["k", "i", "v"], {"v": "sum"}, "test").orderBy("k", "i").collect()
    assert [r["place"] for r in every] == list(range(1, 411)) and [r["run_v"] for r in every] == np.cumsum([r["v"] for r in every]).tolist()


def test_digests_of_a_long_list(spark):
    rows = [("a", i, f"item {i}") for i in range(3000)] + [("b", 5, "")]
    got = dict(digests(spark.createDataFrame(rows, "k string, i long, t string").repartition(5), ["k"], "i", "t", "\n").collect())
    assert got == {"a": hashlib.sha256("\n".join(t for k, _, t in rows if k == "a").encode()).hexdigest(), "b": hashlib.sha256(b"").hexdigest()}


# -- operators 12 and 13

AWKWARD = [
    (1, 0, "system", "Be brief."), (1, 1, "user", "Hello there."), (1, 2, "assistant", "Yes?"), (1, 2, "assistant", "Yes?"), (1, 9, "user", "cut off"),
    (2, None, None, None), (2, 3, "tool", "x."), (2, 3, "", "y!  \n"), (None, 1, "user", "orphan."), (None, None, "assistant", " \t"),
    (3, None, "user", "first"), (3, 5, "system", "late."), (4, 7, "assistant", "a."), (4, 8, "assistant", "b."), (4, 9, "user", "c."),
    (5, 0, "user", "Hello there."), (5, 1, "assistant", "Yes?"), (6, 0, "user", "Hello there."), (6, 1, "assistant", "Yes?"), (10, 1, "assistant", " "),
    *[(7, i, "user" if i % 2 else "assistant", f"turn {i % 5}." if i % 11 else "no end") for i in range(1500)],
    *[(8, i, random.Random(i).choice(["user", "assistant", "system", "other"]), f"t{i}") for i in range(40)],
    *[(100 + k, i, "user" if i % 2 == 0 else "assistant", "same." if i < k % 7 else f"{k % 3}.") for k in range(60) for i in range(6)],
]
SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture
def awkward(spark):
    clashing = {c: F.lit("extra") for c in ("key", "place", "h1", "d", "piece", "codes", "part", "head", "size")}
    return spark.createDataFrame(AWKWARD, SCHEMA).repartition(6).withColumns(clashing)


def conversations_of(rows, null):
    found = collections.defaultdict(list)
    for c, turn, role, text in rows:
        found[c].append((turn is not None, turn or 0, null if role is None else role, null if text is None else text))
    return {c: sorted(v) for c, v in found.items()}


def plain_damage(rows):
    out = []
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = ("user" if k == 4 else role), ("" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        out += [(c, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def plain_repair(rows):
    """The contract's values, by trying every edit of every row."""
    told, faults = set(), []
    for _, _, role, text in rows:
        seen = text.rstrip(WHITE)
        faults.append("b" if not seen else "d" if (role, text) in told else "" if seen[-1] in ".!?" else "t")
        told.add((role, text))
    first = [r[2][:1] for r in rows]
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {("end", s): (0, "", ()) for s in ("", "a")}

    @functools.lru_cache(None)
    def go(i, state, inserts):
        options = [best[("end", state)]] if i == len(rows) and ("end", state) in best else []

        def add(cost, letter, rest, lines=()):
            if rest is not None:
                options.append((cost + rest[0], letter + rest[1], lines + rest[2]))

        for initial, role in (("u", "user"), ("a", "assistant")):
            if initial in after[state]:
                if inserts < 2:
                    add(3, "I", go(i, after[state][initial], inserts + 1), (f"{role}:",))
                if i < len(rows) and faults[i] in ("", "t"):
                    add(3 + 3 * bool(faults[i]), "R", go(i + 1, after[state][initial], 0), (f"{role}:{rows[i][3]}",))
        if i < len(rows):
            add(4, "D", go(i + 1, state, 0))
            if faults[i] in ("", "t") and first[i] in after[state]:
                add(3 * bool(faults[i]), "K", go(i + 1, after[state][first[i]], 0), (f"{rows[i][2]}:{rows[i][3]}",))
        return min(options, key=lambda o: o[:2], default=None)

    for i in range(len(rows), -1, -1):  # from the back, so that calls don't nest
        for state in ("u", "a", "s", ""):
            for inserts in (2, 1, 0):
                go(i, state, inserts)
    cost, audit, lines = go(0, "", 0)
    turns = [t for known, t, _, _ in rows if known]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return {"gaps": gaps, "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"), "illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def same_repairs(got, original, rows):
    want = {c: plain_repair(v) for c, v in conversations_of(rows, " ").items()}
    found = {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in got}
    assert len(got) == len(found) and found == {c: want.get(c) or plain_repair([]) for c in {r[0] for r in original}}


def test_op12_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same_repairs(queries.op12_tensor_repair(spark, sf).collect(), rows, plain_damage(rows))


def test_repair_of_awkward_conversations(spark, awkward, monkeypatch):
    monkeypatch.setattr(repair, "PIECE", 16)
    short = [r for r in AWKWARD if r[0] != 7]
    rows = awkward.filter("conv_id <> 7 OR conv_id IS NULL")
    same_repairs(repair.audited(rows, repair.damaged(rows)).collect(), short, plain_damage(short))
    bare = rows.select(repair.keyed().alias("key"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    same_repairs(repair.audited(rows, bare).collect(), short, short)
    assert repair.audited(awkward.limit(0), repair.damaged(awkward.limit(0))).collect() == []


def test_a_long_conversation_is_repaired_like_many_short_ones():
    rng = random.Random(5)
    codes = [bytes(65 + rng.choice([4, 8, 12, 0, 5, 7, 9, 11, 6]) for _ in range(rng.choice([0, 1, 2, 3, 9, 700]))) for _ in range(60)]
    alone = [repair.solved([c])[0] for c in codes]
    assert repair.solved(codes) == alone and all(len(a[6]) == len(c) for a, c in zip(alone, codes))


def plain_trie(rows):
    own = {c: [r[2:] for r in v] for c, v in conversations_of(rows, "").items() if c is not None}
    members = collections.defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
        for d in range(len(built) + 1):
            members[built[:d]].append((c, len(built)))
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for path, convs in members.items():
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(convs) - 1) * len(path[-1][1].encode()) if path else 0
            leaves[path[:d]] += not children[path]
    least = {p: min(m)[0] for p, m in members.items()}
    ends = lambda p, m: hashlib.sha256(",".join(str(c) for c, n in sorted(m) if n == len(p)).encode()).hexdigest()
    return sorted((least[p], len(p), least[p[:-1]] if p else -1, len(m), children[p], leaves[p], saved[p], ends(p, m)) for p, m in members.items())


def shown(rows):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(-1 if r[n] is None else r[n] for n in names) for r in rows)


def test_op13_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert shown(queries.op13_preorder_trie(spark, sf).collect()) == plain_trie(rows)


def test_trie_of_awkward_conversations(spark, awkward):
    rows = [r for r in AWKWARD if r[0] != 7]
    head, length = F.col("conv_id") - F.col("conv_id") % 5, F.crc32(F.col("conv_id").cast("string")) % 9
    build = lambda df: trie.trie(*trie.grafted(trie.turns(df), head, length))
    found = build(awkward.filter("conv_id <> 7 OR conv_id IS NULL")).collect()
    assert shown(found) == plain_trie(rows)
    # Intervals are those of a preorder: a node's subtree is what lies between its place and its end.
    assert sorted(r["place"] for r in found) == list(range(1, len(found) + 1))
    by_place = {r["place"]: r for r in found}
    for r in found:
        after = by_place.get(r["subtree_end"] + 1)
        assert r["subtree_end"] >= r["place"] and (after is None or after["depth"] <= r["depth"])
        assert all(by_place[p]["depth"] > r["depth"] for p in range(r["place"] + 1, r["subtree_end"] + 1))
    assert build(awkward.limit(0)).collect() == []


def test_a_long_conversation_lies_in_many_partitions(spark, awkward):
    rows = [r for r in AWKWARD if r[0] == 7]
    found = trie.turns(awkward.filter("conv_id = 7")).orderBy("place").collect()
    assert [r["size"] for r in found] == [len(r[3]) for r in sorted(rows, key=lambda r: r[1])]
