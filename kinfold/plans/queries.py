"""Queries over the driver's tables, with the same questions in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..operators import dense
from ..operators import similarity as S
from ..operators.medians import medians
from ..stage import settle

DENSE = 0.30
UOMS = ("EA", "NOS", "KG", "KGS.", "MTR", "N/A")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` in the canonical shape: row_id, description, cpse, code (a third have none), price, uom, label, text."""
    part = read(spark, sf_dir, "part")
    description = F.concat_ws(" ", "p_name", "p_type")
    unit = F.element_at(F.array(*[F.lit(u) for u in UOMS]), F.col("p_size") % len(UOMS) + 1)
    return part.select(
        F.col("p_partkey").alias("row_id"),
        description.alias("description"),
        T.clean_unit(F.col("p_brand")).alias("cpse"),
        F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("P-"), F.col("p_partkey").cast("string"))).otherwise("").alias("code"),
        F.col("p_retailprice").alias("price"),
        T.uom(unit)["canonical"].alias("uom"),
        F.col("p_type").alias("label"),
        T.normalize(description).alias("text"),
    )


def families(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Materials with family_no, golden text and score; and one row per family."""
    rows = materials(spark, sf_dir)
    texts = rows.groupBy("text").agg(F.min("row_id").alias("id")).select("id", "text")
    grams = settle(S.trigrams(texts), "trigrams")
    members = settle(S.communities(settle(S.sparse_edges(grams), "edges")), "members")
    numbered = S.numbered(members)
    joined = members.join(numbered.select("seed", "family_no", "size"), "seed").join(texts.withColumnRenamed("id", "member"), "member")
    golden = joined.groupBy("family_no").agg(F.max_by(F.struct("member", "text"), F.struct(F.char_length("text"), -F.col("member"))).alias("g"))
    pairs = joined.join(golden, "family_no").select("family_no", "member", "text", F.col("g.member").alias("golden_id"), F.col("g.text").alias("golden"))
    a = pairs.select("member", "golden_id").join(grams.select(F.col("id").alias("member"), "gram", F.col("n").alias("na"), F.col("norm2").alias("qa")), "member")
    b = grams.select(F.col("id").alias("golden_id"), "gram", F.col("n").alias("nb"), F.col("norm2").alias("qb"))
    dots = a.join(b, ["golden_id", "gram"]).groupBy("member").agg((F.sum(F.col("na") * F.col("nb")) / F.sqrt((F.first("qa") * F.first("qb")).cast("double"))).alias("cos"))
    score = F.round(F.least(F.greatest(F.coalesce("cos", F.lit(0.0)), F.lit(-1.0)), F.lit(1.0)), 4)
    scored = pairs.join(dots, "member", "left").select("text", "family_no", "golden", score.alias("score"))
    records = settle(rows.join(scored, "text"), "records")
    clusters = records.groupBy("family_no", "golden").agg(F.count(F.lit(1)).alias("members"), F.avg("score").alias("mean"), F.min("score").alias("lowest"), F.countDistinct("cpse").alias("units"))
    return records, clusters


def clean_unit(spark, d):
    return read(spark, d, "part").select("p_partkey", T.clean_unit(F.concat(F.lit("  "), F.lower("p_brand"), F.lit(" "))).alias("unit"))


def normalize_text(spark, d):
    raw = F.concat(F.lower("p_name"), F.lit(" s.s. dia, "), F.col("p_type"), F.lit(";cs/ms"))
    return read(spark, d, "part").select("p_partkey", T.normalize(raw).alias("normalized"))


def normalize_trace(spark, d):
    steps = F.explode(T.trace(F.concat(F.lower("p_name"), F.lit(" dia, ss"))))
    return read(spark, d, "part").select("p_partkey", steps.alias("s")).select("p_partkey", "s.step", "s.before", "s.after")


def price_parse(spark, d):
    raw = F.concat(F.lit("Rs "), F.format_number("o_totalprice", 2), F.lit(" INR"))
    return read(spark, d, "orders").select("o_orderkey", T.parse_price(raw).alias("price"))


def uom_normalize(spark, d):
    unit = F.element_at(F.array(*[F.lit(u) for u in UOMS]), F.col("p_size") % len(UOMS) + 1)
    return read(spark, d, "part").select("p_partkey", T.uom(unit).alias("u")).select("p_partkey", "u.canonical", "u.dimension")


def uom_summary(spark, d):
    return uom_normalize(spark, d).groupBy("dimension").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("canonical").alias("n_canonical"))


def dedupe_first(spark, d):
    """The first row of each set of equal rows; the position stands in for the order of arrival."""
    rows = read(spark, d, "documents").select("doc_id", "text", "lang")
    turn = Window.partitionBy("text", "lang").orderBy("doc_id")
    return rows.withColumn("turn", F.row_number().over(turn)).filter("turn = 1").select("doc_id", "lang")


def profile_columns(spark, d):
    """Statistics of every text column of part, in one pass."""
    part = read(spark, d, "part")
    cells = []
    for c in ("p_name", "p_brand", "p_type"):
        col = F.col(c)
        cells.append(F.struct(F.lit(c).alias("column_name"), F.count(col).alias("n"), F.round(F.avg(F.char_length(col)), 4).alias("mean_len"), F.round(F.countDistinct(col) / F.count(col), 4).alias("distinct_share"), F.round(F.avg(F.when(col.contains(" "), 1.0).otherwise(0.0)), 4).alias("space_share")))
    return part.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def similarity_edges(spark, d):
    return S.dense_edges(vectors(spark, d), DENSE).select("i", "j", F.round("cos", 4).alias("cos"))


def degrees(spark, d):
    return dense.degrees(dense.deal(vectors(spark, d), DENSE))


def communities(spark, d):
    return S.numbered(dense.communities(vectors(spark, d), DENSE)).select("family_no", "seed", "size")


def communities_trigram(spark, d):
    texts = materials(spark, d).groupBy("text").agg(F.min("row_id").alias("id"))
    return S.numbered(S.communities(S.sparse_edges(S.trigrams(texts)))).select("family_no", "seed", "size")


def member_similarity(spark, d):
    records, _ = families(spark, d)
    return records.select("row_id", "family_no", "golden", "score", T.confidence(F.col("score")).alias("confidence"))


def family_status(spark, d):
    _, clusters = families(spark, d)
    return clusters.select("family_no", "golden", "members", "units", F.round("mean", 4).alias("mean_similarity"), F.col("lowest").alias("min_similarity"), T.status(F.col("mean")).alias("status"))


def status_distribution(spark, d):
    return family_status(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n_families"), F.sum("members").alias("n_records"))


def threshold_bands(spark, d):
    """The bands of scores, and the families and records of a run in each."""
    rows, ceiling = [], 1.0
    for name, floor in (*C.STATUS_BANDS, (C.FALLBACK_STATUS, 0.0)):
        rows.append((name, floor, ceiling))
        ceiling = floor
    bands = spark.createDataFrame(rows, "band string, floor double, ceiling double")
    counts = status_distribution(spark, d).withColumnRenamed("status", "band")
    return bands.join(counts, "band", "left").fillna(0, ["n_families", "n_records"])


def unit_counts(spark, d):
    records, _ = families(spark, d)
    counts = records.groupBy("family_no", "cpse").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("family_no").orderBy(F.desc("n"), "cpse")))


def priced_in_basis(records):
    """Priced records in their family's basis unit of measure: the modal one, ties to the first seen."""
    priced = records.filter("price > 0")
    per = priced.groupBy("family_no", "uom").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"))
    basis = per.groupBy("family_no").agg(F.max_by("uom", F.struct("n", -F.col("first"))).alias("basis_uom"), F.sum("n").alias("all_priced"), F.count(F.lit(1)).alias("uom_forms"))
    return priced.join(basis, "family_no").filter("uom = basis_uom")


def price_block(records):
    """The price block of each family within its basis unit of measure."""
    inside = priced_in_basis(records)
    block = inside.groupBy("family_no", "basis_uom", "all_priced", "uom_forms").agg(F.count(F.lit(1)).alias("priced"), F.sum("price").alias("spend"), F.min("price").alias("low"), F.max("price").alias("high"))
    block = block.join(medians(inside, ["family_no"], "price", "mid"), "family_no")
    excess = inside.join(block.select("family_no", "mid"), "family_no").groupBy("family_no").agg(F.sum(F.greatest(F.col("price") - F.col("mid"), F.lit(0.0))).alias("excess"))
    return block.join(excess, "family_no").select(
        "family_no", "basis_uom", "priced", "uom_forms", (F.col("all_priced") - F.col("priced")).alias("other_records"),
        F.round("spend", 2).alias("spend"), F.round("low", 4).alias("price_low"), F.round("high", 4).alias("price_high"), F.round("mid", 4).alias("price_median"),
        F.round(F.col("high") / F.col("low"), 2).alias("price_spread"), F.round(F.col("spend") - F.col("low") * F.col("priced"), 2).alias("savings"), F.round("excess", 2).alias("excess"),
    )


def price_stats(spark, d):
    return price_block(families(spark, d)[0])


def skewed_price_medians(spark, d):
    """The median price of the orders of each priority, where those of most customers count as one kind."""
    orders = read(spark, d, "orders")
    kind = F.when(F.col("o_custkey") % 10 > 0, "MOST").otherwise(F.col("o_orderpriority"))
    return medians(orders.select(kind.alias("kind"), "o_totalprice"), ["kind"], "o_totalprice", "mid").select("kind", F.round("mid", 4).alias("mid"))


def savings_totals(spark, d):
    s = price_stats(spark, d)
    return s.agg(F.round(F.sum("spend"), 1).alias("spend"), F.round(F.sum("savings"), 1).alias("savings"), F.round(F.sum("excess"), 1).alias("excess"), F.count(F.lit(1)).alias("n_families"))


def list_by_unit(spark, d):
    """Families that hold a unit's records, most records first."""
    counts = unit_counts(spark, d).filter("cpse = 'BRAND#1'")
    return counts.select("family_no", F.col("n").alias("n_records"))


def search_families(spark, d):
    """Families whose golden text or any member holds a literal, whatever its case."""
    records, clusters = families(spark, d)
    word = "on"
    hit = records.filter(F.contains(F.lower("description"), F.lit(word))).select("family_no").distinct()
    return clusters.join(hit, "family_no", "left_semi").select("family_no", "golden", "members")


def page_families(spark, d):
    return family_status(spark, d).orderBy("family_no").offset(10).limit(20).select("family_no", "members", "status")


def provenance_spellings(spark, d):
    records, _ = families(spark, d)
    key = T.squeezed(F.col("description"))
    return records.groupBy("family_no", key.alias("spelling")).agg(F.count(F.lit(1)).alias("n_records"), F.min("score").alias("lowest"), F.countDistinct("cpse").alias("n_units"))


def eval_pairwise(spark, d):
    """Pairwise accuracy of trigram families against part types, from counts of the contingency table."""
    records, _ = families(spark, d)
    pairs = lambda c: F.sum((F.col(c) * (F.col(c) - 1) / 2).cast("long"))
    joint = records.groupBy("label", "family_no").agg(F.count(F.lit(1)).alias("n")).agg(pairs("n").alias("tp"))
    truth = records.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(pairs("n").alias("truth"))
    pred = records.groupBy("family_no").agg(F.count(F.lit(1)).alias("n")).agg(pairs("n").alias("pred"))
    total = records.agg(F.count(F.lit(1)).alias("n")).agg(pairs("n").alias("total"))
    one = joint.join(truth).join(pred).join(total)  # four tables of one row
    return one.select(
        "tp", (F.col("pred") - F.col("tp")).alias("fp"), (F.col("truth") - F.col("tp")).alias("fn"), (F.col("total") - F.col("truth") - F.col("pred") + F.col("tp")).alias("tn"),
        F.round(F.col("tp") / F.col("pred"), 4).alias("prec"), F.round(F.col("tp") / F.col("truth"), 4).alias("recall"),
    )


def family_purity(spark, d):
    records, _ = families(spark, d)
    return records.groupBy("family_no").agg((F.countDistinct("label") == 1).alias("pure"), F.count(F.lit(1)).alias("members"))


def threshold_sweep(spark, d):
    """What each floor from .55 to .99 accepts without review; floors are exact decimals."""
    _, clusters = families(spark, d)
    floors = F.explode(F.transform(F.sequence(F.lit(55), F.lit(99)), lambda x: x.cast("decimal(4,2)") / 100)).alias("floor")
    mean = F.round("mean", 4).cast("decimal(6,4)")
    sums = clusters.groupBy(mean.alias("m")).agg(F.count(F.lit(1)).alias("n"), F.sum("members").alias("members"))
    rows = sums.select(floors, "m", "n", "members")
    total = lambda test, of: F.sum(F.when(test, F.col(of)).otherwise(0))
    auto = F.col("m") >= F.col("floor")
    out = rows.groupBy("floor").agg(total(auto, "n").alias("auto"), total(~auto, "n").alias("review"), total(~auto, "members").alias("review_records"))
    return out.select(F.col("floor").cast("double").alias("floor"), "auto", "review", "review_records")


def near_miss_pairs(spark, d):
    """The 36 closest pairs of vectors in a band below the threshold."""
    return dense.best_pairs(vectors(spark, d), 0.25, DENSE, 36).select("i", "j", F.round("cos", 4).alias("cos"))


QUERIES = {f.__name__: f for f in (clean_unit, normalize_text, normalize_trace, price_parse, uom_normalize, uom_summary, dedupe_first, profile_columns, similarity_edges, degrees, communities, communities_trigram, member_similarity, family_status, status_distribution, threshold_bands, unit_counts, price_stats, skewed_price_medians, savings_totals, list_by_unit, search_families, page_families, provenance_spellings, eval_pairwise, family_purity, threshold_sweep, near_miss_pairs)}
