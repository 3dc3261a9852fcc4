"""Prefix trie of conversations, encoded by preorder intervals.

A node is a distinct sequence of first turns (role, text); the root is the
empty one.  A sequence is known by two 64-bit numbers: its turns' hashes, each
made with the turn's place, added up by exclusive or.  So a prefix of any
length comes from a running value over rows in order, and no conversation is
held whole.

Distinct whole sequences are ranked lexicographically: by the children they
take at forks (nodes with several children, or where a conversation ends and
another goes on), a sequence before those it is the beginning of.  A node's
members are then neighbours; its first and last member give its interval.
Nodes sorted by (rank of the first member, depth) are in preorder, and a
subtree ends at the last member's own last node.  Leaves and savings are
running sums over the preorder, and a subtree's are the difference at its ends.

Turns of one conversation are in the order of turn (null first); rows of one
turn in that of role, then text.  Null role or text is empty.  Rows without a
conv_id belong to no conversation.  Repeated rows are turns like others.  An
empty table has no root, so the answer is empty.  Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle
from .running import digests, running

NODE = ["h1", "h2"]
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 1), e1 and e2 (hashes of role and text), size (UTF-8 bytes of the text) of each turn."""
    clean = rows.filter("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    keep = ["conv_id", F.xxhash64("role", "text").alias("e1"), F.xxhash64("text", "role", F.lit("other")).alias("e2"), F.octet_length("text").cast("long").alias("size")]
    return running(clean, "conv_id", ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"], keep, {}, "turns")


def grafted(own: DataFrame, head_of: Column, length: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with another's first turns: their turns (conv_id, d, e1, e2, size, total) and conversations (conv_id, total).

    ``head_of`` names the other conversation and ``length`` how many of its first
    turns come in place of as many of its own.
    """
    counts = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    named = counts.select("conv_id", "n", head_of.alias("head"), length.alias("h"))
    sizes = named.join(counts.select(F.col("conv_id").alias("head"), F.col("n").alias("head_n")), "head", "left")
    taken = F.least(F.col("h"), F.coalesce("head_n", F.lit(0)))
    convs = settle(sizes.select("conv_id", "head", "h", taken.alias("k"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "conversations")
    turn = ["e1", "e2", "size"]
    longest = convs.agg(F.coalesce(F.max("k"), F.lit(0))).first()[0]
    heads = own.filter(F.col("place") <= longest).select(F.col("conv_id").alias("head"), "place", *turn)
    begun = convs.filter("k > 0").join(heads, "head").filter("place <= k").select("conv_id", F.col("place").alias("d"), *turn, "total")
    went_on = own.join(convs, "conv_id").filter("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("k")).alias("d"), *turn, "total")
    return begun.unionByName(went_on), convs.select("conv_id", "total")


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """conv_id, d, node (h1, h2), its parent (p1, p2), size, total of each turn of rebuilt conversations."""
    keep = ["conv_id", "d", "size", "total", F.xxhash64("d", "e1", "e2").alias("a"), F.xxhash64("e2", "d", "e1").alias("b")]
    run = running(rebuilt, "conv_id", ["conv_id", "d"], keep, {"a": "xor", "b": "xor"}, "prefixes")
    return run.select("conv_id", "d", F.col("run_a").alias("h1"), F.col("run_b").alias("h2"), F.col("run_a").bitwiseXOR(F.col("a")).alias("p1"), F.col("run_b").bitwiseXOR(F.col("b")).alias("p2"), "size", "total")


def _ranked(paths: DataFrame, ends: DataFrame, forks: DataFrame) -> DataFrame:
    """h1, h2, rank (a number that grows in lexicographic order) of the distinct whole sequences."""
    last = settle(ends.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id")), "sequences")
    steps = paths.join(last.select("conv_id"), "conv_id", "left_semi").select("conv_id", "d", *NODE, "p1", "p2")
    # The root is taken as a fork, so that no join has one key for all conversations.
    taken = steps.filter("d = 1").unionByName(steps.filter("d > 1").join(forks.select(F.col("h1").alias("p1"), F.col("h2").alias("p2")), ["p1", "p2"], "left_semi").select(*steps.columns))
    key = F.transform(F.array_sort(F.collect_list(F.struct("d", *NODE))), lambda s: F.struct(s["h1"].alias("h1"), s["h2"].alias("h2")))  # a conversation's forks
    keyed = last.join(taken.groupBy("conv_id").agg(key.alias("key")), "conv_id", "left")
    empty = F.array().cast("array<struct<h1:bigint,h2:bigint>>")
    ordered = keyed.select(*NODE, F.coalesce("key", empty).alias("key")).repartitionByRange("key").sortWithinPartitions("key")
    return settle(ordered.select(*NODE).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def trie(rebuilt: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, place and subtree_end (in preorder), parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = settle(prefixes(rebuilt), "paths")
    nil = F.lit(0).cast("long")
    ends = paths.filter("d = total").select("conv_id", *NODE).unionByName(convs.filter("total = 0").select("conv_id", nil.alias("h1"), nil.alias("h2")))
    ends = settle(ends, "ends")
    met = paths.groupBy(*NODE).agg(F.first("d").alias("depth"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("size").alias("size"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(nil.alias("h1"), nil.alias("h2"), nil.alias("depth"), "conv_id", "n_convs", F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), nil.alias("size"))
    met = settle(met.withColumn("depth", F.col("depth").cast("long")).unionByName(root), "met")
    children = met.filter("depth > 0").groupBy(F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(F.count(F.lit(1)).alias("n_children"))
    ending = ends.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_ends"))
    nodes = met.join(children, NODE, "left").join(ending, NODE, "left").fillna(0, ["n_children", "n_ends"])
    nodes = settle(nodes, "nodes")
    forks = nodes.filter("depth > 0 AND n_children > 0 AND n_children + n_ends > 1").select(*NODE)
    ranks = _ranked(paths, ends, forks)
    ranked = settle(ends.join(ranks, NODE).select("conv_id", "rank"), "conversation-ranks")
    span = [F.min("rank").alias("first"), F.max("rank").alias("last")]
    spans = paths.select("conv_id", *NODE).join(ranked, "conv_id").groupBy(*NODE).agg(*span)
    spans = spans.unionByName(ranked.agg(*span).select(nil.alias("h1"), nil.alias("h2"), "first", "last"))
    spanned = nodes.join(spans, NODE)
    keep = [*NODE, "p1", "p2", "depth", "conv_id", "n_convs", "n_children", "n_ends", "first", "last", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved")]
    order = running(spanned, None, ["first", "depth"], keep, {"leaf": "sum", "saved": "sum"}, "preorder")
    order = settle(order, "preorder")
    # The last member's own last node is the only one of those it brings that a conversation ends at.
    stops = order.filter("n_ends > 0").select(F.col("first").alias("last"), F.col("place").alias("subtree_end"), F.col("run_leaf").alias("to_leaf"), F.col("run_saved").alias("to_saved"))
    inside = order.join(stops, "last")
    parents = met.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    marks = digests(ends.withColumn("item", F.col("conv_id").cast("string")), NODE, "conv_id", "item", ",")
    whole = inside.join(parents, ["p1", "p2"], "left").join(marks, NODE, "left")
    return whole.select(
        "conv_id", "depth", "place", "subtree_end", "parent_conv_id", "n_convs", "n_children",
        (F.col("to_leaf") - F.col("run_leaf") + F.col("leaf")).alias("n_leaves"),
        (F.col("to_saved") - F.col("run_saved") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
