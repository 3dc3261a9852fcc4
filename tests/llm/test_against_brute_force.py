"""Queries and pipeline stages against plain Python over whole tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_duplicates import classes_of, plain_fingerprint
from test_other_operators import base_by_regex, windows_of, words_of

from kinfold.llm import decontam, langid, packing, pii, quality, queries, simhash


def crc_of(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def plain_statistics(text):
    """The classifier's statistics, counted character by character."""
    n, words, lines = max(len(text), 1), text.split(), text.split("\n")
    count = lambda chars: sum(c in chars for c in text)
    ratio = lambda x: np.log(x + 1e-3)
    groups = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:'\"()-?", "#$%&*+/<=>@[\\]^_`{}~", "|", "!", "\n"]
    out = [np.log1p(len(text)), np.log1p(len(text) / max(len(words), 1)), np.log1p(max(map(len, words), default=0))]
    out += [ratio(count(g) / n) for g in groups] + [ratio(sum(c > "\x7f" for c in text) / n)]
    ends = sum(not w[-1].isalnum() and w[-1] not in ".,;:" for w in words)
    return [*out, np.log1p(len(set(words))) - np.log1p(len(words)), ratio(len(set(lines)) / len(lines)), ratio(ends / max(len(words), 1))]


def plain_quality(docs, labels, learn):
    """Scores by the densities' formulas, with explicit inverses."""
    x = {i: np.array(plain_statistics(t or "")) for i, t in docs}
    some = [(x[i], q) for i, q in labels if learn(i) and i in x]
    of = [np.array([v for v, q in some if q == c]) for c in (0, 1)]
    share = np.array([len(o) for o in of]) / len(some)
    covs = [np.cov(o.T, bias=True) for o in of]
    pooled = share[0] * covs[0] + share[1] * covs[1]
    scale = np.outer(s := np.sqrt(np.maximum(np.diag(pooled), 1e-6)), s)
    every, logs = np.array([x[i] for i, _ in docs]), []
    for c in (0, 1):
        cov = ((1 - quality.RIDGE) * ((1 - quality.POOL) * covs[c] + quality.POOL * pooled) / scale + quality.RIDGE * np.eye(len(scale))) * scale
        d = every - of[c].mean(axis=0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov / scale)[1]) + np.log(share[c]))
    return dict(zip((i for i, _ in docs), 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / quality.TEMPER, -700, 700)))))


@pytest.fixture(scope="module")
def documents(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def test_op2_whole_table(spark, sf, documents):
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()]
    want = plain_quality(documents, labels, lambda i: crc_of(i, 5) != 0)
    got = queries.op2_quality_qda(spark, sf).collect()
    assert len(got) == len(documents)
    for r in got:
        assert abs(r["score"] - want[r["doc_id"]]) < 1e-6 and r["held_out"] == (crc_of(r["doc_id"], 5) == 0) and r["predicted"] == int(r["score"] >= 0.3)


def plain_profile(text):
    """The profile of a text, one n-gram after another."""
    spaced = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    letters = " ".join(re.findall(r"[^ ]+", spaced))
    if not letters:
        return None
    padded, total = f" {letters} ", np.zeros(langid.DIMENSIONS)
    for gram, n in Counter(padded[i : i + 3] for i in range(len(padded) - 2)).items():
        bound = np.ones(langid.DIMENSIONS)
        for place, letter in enumerate(gram):
            vector = np.random.default_rng((langid.SEED, ord(letter))).integers(0, 2, langid.DIMENSIONS, np.int8) * 2.0 - 1
            bound *= np.roll(vector, place)
        total += n * bound
    return total / np.linalg.norm(total)


def test_op9_on_many_texts(spark, sf, documents, monkeypatch):
    """Prototypes and cosines, from every n-gram bound by itself; this table has fewer rows a language than train the model."""
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    texts = dict(documents)
    assert max(Counter(lang.values()).values()) < langid.TRAIN_ROWS
    some = [i for i in texts if crc_of(i, 3) != 1 and len(texts[i] or "") < 4000][:150] + [i for i in texts if crc_of(i, 3) == 1 and len(texts[i] or "") < 4000][:60]
    profiles = {i: plain_profile(texts[i]) for i in some}
    mine = spark.createDataFrame([(i, texts[i], lang[i]) for i in some], "doc_id long, text string, lang string")
    monkeypatch.setattr(queries, "table", lambda *names: mine)
    sums = {}
    for i, p in profiles.items():
        if crc_of(i, 3) != 1 and p is not None and lang[i] is not None:
            sums[lang[i]] = sums.get(lang[i], 0) + p
    models = {name: v / np.linalg.norm(v) for name, v in sums.items()}
    got = {r["doc_id"]: r for r in queries.op9_hyperdimensional_langid(spark, sf).collect()}
    assert set(got) == set(some) and len(models) == 4
    for i, p in profiles.items():
        assert got[i]["held_out"] == (crc_of(i, 3) == 1)
        if p is None:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        cosines = {name: float(v @ p) for name, v in models.items()}
        best = max(cosines.values())
        assert abs(got[i]["score"] - min(1, max(0, best))) < 1e-5 and cosines[got[i]["lang_pred"]] > best - 1e-5


def optimal(sizes, capacity):
    """The least number of bins, over all subsets."""
    least = [(99, 0)] * (1 << len(sizes))
    least[0] = (1, 0)
    for done in range(len(least)):
        bins, used = least[done]
        for i, size in enumerate(sizes):
            if not done >> i & 1:
                least[done | 1 << i] = min(least[done | 1 << i], (bins, used + size) if used + size <= capacity else (bins + 1, size))
    return least[-1][0]


def test_solver_on_small_pieces():
    """Twelve to sixteen pieces of 8 to 45 in bins of 100: never worse than the optimum, often better than best fit."""
    better = 0
    for seed in range(2000):
        rng = random.Random(seed)
        sizes = [rng.randint(8, 45) for _ in range(rng.randint(12, 16))]
        counts = np.bincount(sizes, minlength=101)
        used = sum(t for _, t in packing.solve(Counter(sizes), 100))
        better += used < sum(t for _, t in packing.best_fit(counts))
        if used > packing.lower_bound(counts):
            assert used == optimal(sizes, 100), sizes
    assert better > 100


def test_packing_beats_best_fit(spark):
    """Documents for which best fit needs a sequence more than the search finds."""
    for seed in range(1000):
        rng = random.Random(seed)
        sizes = [rng.randint(8, 45) for _ in range(14)]
        counts = np.bincount(sizes, minlength=101)
        least = packing.lower_bound(counts)
        if sum(t for _, t in packing.best_fit(counts)) > least == sum(t for _, t in packing.solve(Counter(sizes), 100)):
            break
    docs = spark.createDataFrame([(i, " a" * (n - 1)) for i, n in enumerate(sizes)], "doc_id long, text string")
    rows = packing.pack(docs, capacity=100).collect()
    assert sorted(r["length"] for r in rows) == sorted(sizes) and len({r["sequence_id"] for r in rows}) == least


def contaminated(text, wins):
    ws = words_of(text)
    hit = {p for n in {len(w) for w in wins} for s in range(len(ws) - n + 1) if tuple(ws[s : s + n]) in wins for p in range(s, s + n)}
    return bool(hit) and 20 * len(hit) >= len(ws)


def masked(text):
    """The text with plain identifiers replaced, where the transducer finds no others."""
    out, at = [], 0
    for kind, a, b in sorted(base_by_regex(text), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def test_pipeline_stages_against_plain_python(spark, sf, documents):
    """Each stage on all that the stage before kept."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()]
    wins = set().union(*(windows_of(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()))
    stages, now = dict(cp.STAGES), dict(documents)

    def run(name):
        nonlocal docs
        docs = cp.settle(stages[name](spark, docs, sf), name)
        assert docs.columns == columns
        return {r["doc_id"]: r["text"] for r in docs.collect()}

    scores = plain_quality(documents, labels, lambda i: True)
    assert min(abs(s - 0.3) for s in scores.values()) > 1e-6
    now = {i: t for i, t in now.items() if scores[i] >= 0.3}
    assert run("quality") == now
    roots = classes_of([(i, plain_fingerprint(t)) for i, t in sorted(now.items())])
    now = {i: t for i, t in now.items() if roots[i] == i}
    assert run("near_duplicates") == now
    now = {i: t for i, t in now.items() if not contaminated(t, wins)}
    assert run("decontamination") == now
    plain = {i: masked(t or "") if pii.find(t)[0] == pii.find(t)[1] else None for i, t in now.items()}
    got = run("personal_data")
    assert set(got) == set(now) and all(plain[i] is None or got[i] == plain[i] for i in now) and sum(p is None for p in plain.values()) < len(now) / 20
    assert all(pii.find(t)[1] == [] for t in got.values() if t)
    rows = stages["packing"](spark, docs, sf).collect()
    counts = np.bincount([r["length"] for r in rows], minlength=2049)
    assert {r["doc_id"] for r in rows} == set(got) and len({r["sequence_id"] for r in rows}) <= packing.lower_bound(counts) + 1


def test_pipeline_on_awkward_documents(spark, odd_docs, no_docs, tmp_path):
    """The chain on null, empty, very long and repeated texts, a null id and clashing columns; then on nothing."""
    import corpus_pipeline as cp

    bench = spark.createDataFrame([(1, "words that stand here and mean little at all today"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(5, 1), (6, 1), (0, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    for docs in (odd_docs, no_docs):
        folder = f"file://{tmp_path}/{docs.count()}"
        for name, frame in (("documents", docs), ("benchmark", bench), ("labels", labels)):
            frame.write.parquet(f"{folder}/{name}.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in cp.STAGES[:-1]:
            now = cp.settle(stage(spark, now, folder), name)
            assert now.columns == docs.columns
        kept = {r["doc_id"] for r in now.collect()}
        rows = cp.run(spark, folder).collect()
        assert {r["doc_id"] for r in rows} == kept and all(r["length"] <= 2048 for r in rows)
        assert kept <= {r["doc_id"] for r in docs.collect()} and (not kept or (5 in kept and 0 not in kept and 1 not in kept))


def test_keep_one_is_settled_by_the_other_columns(spark):
    rows = [(1, "a b c d", "z", None), (1, "a b c d", "m", 4), (1, "a b c d", "m", 3)]
    for turn in (rows, rows[::-1]):
        kept = simhash.keep_one(spark.createDataFrame(turn, "doc_id long, text string, key string, n long")).collect()
        assert [tuple(r) for r in kept] == [(1, "a b c d", "m", 3)]


def test_contamination_of_whole_table(spark, sf, documents):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    wins = set().union(*(windows_of(r["text"]) for r in bench.collect()))
    got = {r["doc_id"]: r["contaminated"] for r in queries.op6_positional_decontamination(spark, sf).collect()}
    assert got == {i: contaminated(t, wins) for i, t in documents}
    assert decontam.clean(docs, bench).count() == sum(not c for c in got.values())
