"""Benchmark decontamination over a distributed positional inverted index.

A test item is cut into windows of ``WINDOW`` consecutive words (shorter items
are one window).  For each window the terms that are rarest in the corpus are
its anchors.  The index stores (term, document, position) for training tokens;
candidates come from the postings of a window's rarest term, moved by the
term's offset, and are intersected with the offset-adjusted postings of the
next rarest ones.  What is left is compared word by word with the documents,
so the result is exact.  ``write_index`` stores the postings of all tokens for
several benchmarks; without a stored index those of the anchors are made for
the call.

Proximity matches allow a slop: the rarest term of a window (the first of
equally rare ones) stands at its place and every other term within ``slop``
words of its own.

Terms are 64-bit hashes inside the index; the comparison at the end makes
collisions harmless.  Windows, terms and keys of documents with candidates are
broadcast only up to ``BROADCAST_ROWS`` rows, counted first; beyond that the
joins shuffle.  Documents without candidates are not shuffled.

Everything here is DataFrame functions.  Null text has no words.  Rows that
are alike in doc_id and text give alike results, each once per row.  Without
items, or without documents, nothing is hit.  Other columns of documents stay,
whatever they are called; those of items are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, settle

WINDOW, ANCHORS = 13, 3
#: Rows of fixed-size keys (about 32 bytes each) that are broadcast at most.
BROADCAST_ROWS = 300_000
#: Folders of a stored index (a power of two).
SLOTS = 1024
#: Fixed value: what separates words after A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for null."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), GAP), ""), F.array().cast("array<string>"))


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def _small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it has few enough rows of fixed size."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: wid, phrase (words joined by spaces), n, terms (hashes in order), items (ids as strings)."""
    items = bench.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("ws")).filter((F.size("ws") > 0) & F.col("item").isNotNull())
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.size("ws") - (window - 1), F.lit(1))), lambda s: F.slice("ws", s, window))
    each = items.select("item", F.explode(cut).alias("ws")).select("item", F.concat_ws(" ", "ws").alias("phrase"))
    grouped = each.groupBy("phrase").agg(F.array_sort(F.collect_set("item")).alias("items"))
    ws = F.split("phrase", " ")
    return grouped.select(F.xxhash64("phrase").alias("wid"), "phrase", F.size(ws).alias("n"), F.transform(ws, lambda w: F.xxhash64(w)).alias("terms"), "items")


def token_postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """The positional index: term, key (of the document's row), pos; of all tokens, or of ``terms`` only."""
    tokens = docs.select(row_key().alias("key"), F.posexplode(words(F.col("text"))).alias("pos", "word"))
    postings = tokens.select(F.xxhash64("word").alias("term"), "key", "pos")
    return postings if terms is None else postings.join(terms, "term", "left_semi")


def _slot(term: Column) -> Column:
    """The folder that a term's postings are in: SLOTS ranges of the terms' hashes."""
    return F.shiftrightunsigned(term, 64 - SLOTS.bit_length() + 1).cast("int")


def write_index(docs: DataFrame, folder: str) -> None:
    """Store the postings of all tokens in SLOTS folders by ranges of terms, each in the order of terms."""
    order = ["slot", "term", "key", "pos"]  # a term with very many postings is cut between documents
    postings = token_postings(docs).withColumn("slot", _slot(F.col("term")))
    postings.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("slot").parquet(folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("term long, key long, pos int, slot int").parquet(folder)


def postings_of(index: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored postings of ``terms``; only the folders that hold one of them are read."""
    slots = [r[0] for r in terms.select(_slot(F.col("term"))).distinct().collect()]  # SLOTS rows at most
    return index.filter(F.col("slot").isin(slots)).join(terms, "term", "left_semi").select("term", "key", "pos")


def term_counts(postings: DataFrame) -> DataFrame:
    """Occurrences of each term: term, times."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("times"))


def anchored(wins: DataFrame, counts: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """wid, anchors (array of term, off; rarest first, filled up to ``anchors``) of windows whose terms all occur."""
    terms = wins.select("wid", "n", F.posexplode("terms").alias("off", "term"))
    ranked = terms.join(counts, "term").groupBy("wid", "n").agg(F.array_sort(F.collect_list(F.struct("times", "off", "term"))).alias("a"))
    full = F.array_repeat(F.element_at("a", 1), anchors)
    chosen = F.slice(F.concat(F.slice("a", 1, anchors), full), 1, anchors)
    return ranked.filter(F.size("a") == F.col("n")).select("wid", F.transform(chosen, lambda x: F.struct(x["term"].alias("term"), x["off"].alias("off"))).alias("anchors"))


def intersect(postings: DataFrame, anchors_of: DataFrame, slop: int = 0, anchors: int = ANCHORS) -> DataFrame:
    """key, wid, start where the rarest anchor stands at its offset and each other within ``slop`` of its own."""
    first = anchors_of.select("wid", "anchors", F.col("anchors")[0]["term"].alias("term"), F.col("anchors")[0]["off"].alias("off"))
    found = postings.join(_small(first), "term").select("key", "wid", "anchors", (F.col("pos") - F.col("off")).alias("start"))
    if not slop:
        found = found.filter("start >= 0")
    step = slop + 1
    slots = postings.select("key", "term", F.col("pos").alias("p"), F.floor(F.col("pos") / step).alias("slot"))
    for i in range(1, anchors):
        at = F.col("start") + F.col("anchors")[i]["off"]
        want = found.select("key", "wid", "anchors", "start", F.col("anchors")[i]["term"].alias("term"), at.alias("at"))
        if slop:
            near = want.withColumn("slot", F.explode(F.array(*[F.floor(F.col("at") / step) + d for d in (-1, 0, 1)])))
            on = ["key", "term", "slot"]
            found = near.join(slots, on).filter(F.abs(F.col("p") - F.col("at")) <= slop).select("key", "wid", "anchors", "start").distinct()
        else:
            found = want.withColumn("p", F.col("at")).join(slots.select("key", "term", "p"), ["key", "term", "p"], "left_semi").select("key", "wid", "anchors", "start")
    return found.select("key", "wid", "start")


def candidates(docs: DataFrame, wins: DataFrame, slop: int = 0, index: DataFrame | None = None) -> DataFrame:
    """key, wid, start of the windows that the index (a stored one, or one made here) finds in the documents."""
    some = lambda terms: token_postings(docs, terms) if index is None else postings_of(index, terms)
    vocabulary = settle(wins.select(F.explode("terms").alias("term")).distinct(), "vocabulary")
    counts = settle(term_counts(some(_small(vocabulary))), "term-counts")
    anchors_of = settle(anchored(wins, counts), "anchors")
    terms = anchors_of.select(F.explode("anchors.term").alias("term")).distinct()
    return intersect(settle(some(_small(terms)), "postings"), anchors_of, slop)


def _parted(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that may have hits, as doc (a struct of the row) and key, and those that have none for sure.

    Where more documents have candidates than can be broadcast, all may have hits.
    """
    rows = docs.select(F.struct("*").alias("doc"), row_key().alias("key"))
    keys = found.select("key").distinct()
    if keys.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return rows, rows.limit(0)
    return rows.join(F.broadcast(keys), "key", "left_semi"), rows.join(F.broadcast(keys), "key", "left_anti")


def marks(docs: DataFrame, bench: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """doc (a struct of the row), n_words, n_hit and items (sorted ids) of each document.

    A word is hit if it lies inside an occurrence of a window.
    """
    wins = settle(windows(bench), "windows")
    found = settle(candidates(docs, wins, index=index), "candidates")
    near, rest = _parted(docs, found)
    starts = found.groupBy("key", "wid").agg(F.collect_set("start").alias("starts")).join(wins.select("wid", "phrase", "n", "items"), "wid")
    here = starts.groupBy("key").agg(F.collect_list(F.struct("starts", "n", "phrase", "items")).alias("found"))
    rows = near.join(here, "key", "left").select("doc", "found", words(F.col("doc.text")).alias("ws"))
    # Of each window the places where it does stand.
    stands = F.transform("found", lambda c: F.struct(F.filter(c["starts"], lambda s: F.concat_ws(" ", F.slice(F.col("ws"), s + 1, c["n"])) == c["phrase"]).alias("starts"), c["n"].alias("n"), c["items"].alias("items")))
    rows = rows.select("doc", F.size("ws").alias("n_words"), F.filter(stands, lambda c: F.size(c["starts"]) > 0).alias("same"))
    places = F.flatten(F.transform("same", lambda c: F.flatten(F.transform(c["starts"], lambda s: F.sequence(s, s + c["n"] - 1)))))
    hit = F.when(F.col("same").isNull(), 0).otherwise(F.size(F.array_distinct(places)))
    none = F.array().cast("array<string>")
    items = F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.col("same.items")))), none)
    marked = rows.select("doc", F.col("n_words").cast("long").alias("n_words"), hit.cast("long").alias("n_hit"), items.alias("items"))
    return marked.unionByName(rest.select("doc", F.size(words(F.col("doc.text"))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), none.alias("items")))


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def near_matches(docs: DataFrame, bench: DataFrame, slop: int, index: DataFrame | None = None) -> DataFrame:
    """doc_id, item_id (as string), start: where a window's rarest term stands at its place and all its others within ``slop`` words of theirs."""
    wins = settle(windows(bench), "windows")
    found = settle(candidates(docs, wins, slop, index), "candidates")
    near, _ = _parted(docs, found)
    texts = near.select("key", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text")).distinct()
    here = found.join(wins.select("wid", "phrase", "items"), "wid").groupBy("key").agg(F.collect_list(F.struct("start", "phrase", "items")).alias("found"))
    rows = texts.join(here, "key").select("doc_id", "found", words(F.col("text")).alias("ws"))

    def stands(c: Column) -> Column:
        def term(word: Column, i: Column) -> Column:
            place = c["start"] + i
            first, last = F.greatest(place - slop, F.lit(0)), F.greatest(place + slop, F.lit(-1))
            return F.array_contains(F.slice(F.col("ws"), first + 1, F.greatest(last - first + 1, F.lit(0))), word)

        return F.forall(F.transform(F.split(c["phrase"], " "), term), lambda x: x)

    same = F.explode(F.filter("found", stands)).alias("c")
    return rows.select("doc_id", same).select("doc_id", F.explode("c.items").alias("item_id"), "c.start").distinct()


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    return marks(docs, bench).filter(~is_contaminated()).select("doc.*")
