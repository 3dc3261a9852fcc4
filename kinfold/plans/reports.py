"""Reports on a run: its figures, the whole sweep, spend, provenance, lists and pages; with the same in DuckDB SQL.

Each report is a function of a run's records and families; the queries apply
them to the materials of ``part``, or, where those vary too little, to orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..operators import codes, enrich, runs
from ..operators import similarity as S
from ..streaming import assign
from . import decisions, oracle as O
from .queries import families, price_block, priced_in_basis, read
from .review import ORACLE as _REVIEW, unit_medians_of

UNIT, WORD = "BRAND#1", "on"
#: Units of measure as people write them, dealt to parts in turn.
DIRTY_UNITS = ("NOS.", " No's", "ea", "10 KG", "KGS", "BOXS", "SQ.M", "M.T.", "Lot", "#N/A", "-", "", "WIDGET", "widget ", "FOO/BAR", "2 ROLLS", "(PCS)", "mtr.", "#REF!", "0", "12", "St", "S", "l/t", "cu.m")
_STATUSES = [name for name, _ in C.STATUS_BANDS] + [C.FALLBACK_STATUS]


def _pending() -> Column:
    return F.col("status").isin("review", "conflict")


def with_status(clusters: DataFrame) -> DataFrame:
    return clusters.withColumns({"status": T.status(F.col("mean")), "score": F.round("mean", 4), "code": runs.family_code(F.col("family_no"))})


def pct(part: Column, whole: Column, digits: int) -> Column:
    """A share in percent; 0 of nothing is 0."""
    return F.coalesce(F.round(F.try_divide(100 * part, whole), digits), F.lit(0.0))


def stats(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: records, families, collapsed, fan_in, families to review and of each status, and records of no known unit."""
    per = with_status(clusters).agg(F.count(F.lit(1)).alias("families"), F.coalesce(F.sum("members"), F.lit(0)).alias("records"), F.count_if(_pending()).alias("review_families"), *[F.count_if(F.col("status") == s).alias(s) for s in _STATUSES])
    unknown = records.agg(F.count_if(F.col("cpse") == C.UNSPECIFIED).alias("unspecified"))
    fan_in = F.coalesce(F.round(F.try_divide(F.col("records"), F.col("families")), 2), F.lit(0.0))
    return per.join(unknown).select("records", "families", (F.col("records") - F.col("families")).alias("collapsed"), fan_in.alias("fan_in"), "review_families", *_STATUSES, "unspecified")  # two tables of one row


def distribution(clusters: DataFrame) -> DataFrame:
    """One row: the share of families of each status in percent, and the families of each view."""
    every = F.count(F.lit(1))
    shares = [pct(F.count_if(F.col("status") == s), every, 1).alias(f"{s}_pct") for s in _STATUSES]
    return with_status(clusters).agg(*shares, every.alias("view_all"), F.count_if(_pending()).alias("view_review"), F.count_if(F.col("status") == "resolved").alias("view_resolved"), F.count_if(F.col("members") >= C.FAN_IN_MEMBERS).alias("view_fanin"))


def labelled(records: DataFrame) -> DataFrame:
    """Records with a label, trimmed."""
    return records.withColumn("label", F.trim("label")).filter("label <> '' AND lower(label) <> 'nan'")


def sweep(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """For each floor from .55 to .99: what is accepted unseen, what a person sees, and, by the labels, what of it is wrong.

    A family without labels counts as neither right nor wrong.  Families are
    summed by score first; the floors, 45 of them, meet those sums.
    """
    pure = labelled(records).groupBy("family_no").agg((F.min("label") == F.max("label")).alias("pure"))
    mean = F.round("mean", 4).cast("decimal(6,4)")
    rows = clusters.join(pure, "family_no", "left").groupBy(mean.alias("m"), "pure").agg(F.count(F.lit(1)).alias("n"), F.sum("members").alias("members"))
    floors = F.explode(F.transform(F.sequence(F.lit(55), F.lit(99)), lambda x: x.cast("decimal(4,2)") / 100)).alias("floor")
    total = lambda test, of="n": F.coalesce(F.sum(F.when(test, F.col(of))), F.lit(0))
    auto = F.col("m") >= F.col("floor")
    wrong = ~F.col("pure")
    sums = rows.select(floors, "m", "pure", "n", "members").groupBy("floor").agg(
        total(auto).alias("auto"), total(~auto).alias("review"), total(~auto, "members").alias("review_records"), total(auto & F.col("pure").isNotNull()).alias("auto_judged"),
        total(auto & F.col("pure")).alias("right"), total(~auto & wrong).alias("wrong_caught"), total(auto & wrong).alias("wrong_shipped"),
    )
    share = F.round(F.col("auto") / (F.col("auto") + F.col("review")), 4)
    correct = F.round(F.try_divide("right", "auto_judged"), 4)
    return sums.select(F.col("floor").cast("double").alias("floor"), "auto", "review", "review_records", share.alias("auto_share"), "auto_judged", correct.alias("auto_correct"), "wrong_caught", "wrong_shipped")


def worst_units(records: DataFrame) -> DataFrame:
    """family_no, outlier_unit, outlier_ratio, outlier_excess: of the owners with five priced rows or more, the one whose median is furthest above the family's.

    Of equals the one met first.  The excess is what that owner paid above the family's median.
    """
    inside = priced_in_basis(records)
    per = unit_medians_of(records).filter("raw_ratio > 1")
    first = inside.groupBy("family_no", "cpse").agg(F.min("row_id").alias("first"))
    worst = per.join(first, ["family_no", "cpse"]).groupBy("family_no").agg(F.max_by(F.struct("cpse", "raw_ratio", "mid"), F.struct("raw_ratio", -F.col("first"))).alias("w")).select("family_no", "w.*")
    over = inside.join(worst, ["family_no", "cpse"]).groupBy("family_no", "cpse", "raw_ratio").agg(F.sum(F.greatest(F.col("price") - F.col("mid"), F.lit(0.0))).alias("x"))
    return over.select("family_no", F.col("cpse").alias("outlier_unit"), F.round("raw_ratio", 3).alias("outlier_ratio"), F.round("x", 2).alias("outlier_excess"))


def savings(records: DataFrame) -> DataFrame:
    """One row of totals over the families with a price: spend, what the cheapest and the median price would save, and owners who pay more."""
    block = price_block(records).join(worst_units(records), "family_no", "left")
    far = F.col("outlier_ratio") > C.UNIT_OUTLIER_RATIO
    every = records.agg(F.count(F.lit(1)).alias("all_records"))
    sums = block.agg(
        F.count(F.lit(1)).alias("families"), F.sum("spend").alias("spend"), F.sum("excess").alias("excess"), F.sum("savings").alias("best"), F.sum("priced").alias("priced"),
        F.count_if(far).alias("outlier_families"), F.coalesce(F.sum(F.when(far, F.col("outlier_excess"))), F.lit(0.0)).alias("outlier_excess"),
    )
    of = lambda c: pct(F.col(c), F.col("spend"), 2)
    return sums.join(every).select(  # two tables of one row
        "families", F.round("spend", 1).alias("spend"), F.round("excess", 1).alias("excess_over_median"), of("excess").alias("excess_pct"), F.round("best", 1).alias("against_best_price"), of("best").alias("best_pct"),
        F.col("priced").alias("priced_records"), (F.col("all_records") - F.col("priced")).alias("unpriced_records"), "outlier_families", F.round("outlier_excess", 1).alias("outlier_excess"),
    )


def top_savings(records: DataFrame, limit: int = 25) -> DataFrame:
    """The families with most spend above their median."""
    block = price_block(records).join(worst_units(records), "family_no", "left")
    return block.orderBy(F.desc("excess"), "family_no").limit(limit).select("family_no", "spend", "excess", "savings", "price_spread", "outlier_unit", "outlier_ratio", "outlier_excess")


def price_details(records: DataFrame) -> DataFrame:
    """The price block of each family with a price, its worst owner, and unit_medians: its owners' medians (unit, median, records, ratio), dearest first."""
    own = F.struct((-F.col("raw_ratio")).alias("less"), F.col("cpse").alias("unit"), F.round("median", 2).alias("median"), F.col("n").alias("records"), F.round("raw_ratio", 3).alias("ratio"))
    units = unit_medians_of(records).groupBy("family_no").agg(F.transform(F.array_sort(F.collect_list(own)), lambda u: u.dropFields("less")).alias("unit_medians"))  # a row for each owner
    none = F.array().cast("array<struct<unit:string,median:double,records:bigint,ratio:double>>")
    return price_block(records).join(worst_units(records), "family_no", "left").join(units, "family_no", "left").withColumn("unit_medians", F.coalesce("unit_medians", none))


def cluster_page(records: DataFrame, clusters: DataFrame, name: str = "all", offset: int = 0, limit: int = C.PAGE_FAMILIES, flags: DataFrame | None = None, standards: DataFrame | None = None) -> DataFrame:
    """One page of a view: families with their spellings counted, and what a model's answers say of them (flags, standard)."""
    shown = page(view(spelling_counts(records, with_status(clusters)), name), ["family_no"], offset, limit)
    return enrich.overlay(shown, flags, standards)


def cluster_detail(records: DataFrame, clusters: DataFrame, family_no: int, limit: int = 200, flags: DataFrame | None = None, standards: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A family with its price block and overlay, one row, and its first members, the best scores first."""
    own = records.filter(F.col("family_no") == family_no)
    head = enrich.overlay(with_status(clusters.filter(F.col("family_no") == family_no)), flags, standards).join(price_details(own), "family_no", "left")
    members = own.select("row_id", "description", "text", "cpse", "code", "score", T.confidence(F.col("score")).alias("confidence"), (F.col("text") == F.col("golden")).alias("is_golden"))
    return head, members.orderBy(F.desc("score"), "row_id").limit(limit)


def unit_list(inside: DataFrame) -> DataFrame:
    """family_no, uom_list: the units of measure of a family's priced records as NAME:count, most first, joined by bars."""
    per = inside.groupBy("family_no", "uom").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "first", "uom", "n")))  # units of measure of one family
    return per.groupBy("family_no").agg(F.array_join(F.transform(ordered, lambda u: F.concat(u["uom"], F.lit(":"), u["n"].cast("string"))), "|").alias("uom_list"))


def holds(records: DataFrame, clusters: DataFrame, word: str) -> DataFrame:
    """The families whose golden text, code, or any member's text or own code holds a word literally, whatever its case."""
    word = word.strip().lower()
    if not word:
        return clusters
    inside = lambda c: F.contains(F.lower(F.col(c)), F.lit(word))
    hit = records.filter(inside("description") | inside("code")).select("family_no").distinct().withColumn("hit", F.lit(True))
    return clusters.join(hit, "family_no", "left").filter(F.coalesce("hit", F.lit(False)) | inside("golden") | F.contains(F.lower(runs.family_code(F.col("family_no"))), F.lit(word))).drop("hit")


def view(clusters: DataFrame, name: str) -> DataFrame:
    """The families of a view: all, review, resolved or fanin."""
    tests = {"all": F.lit(True), "review": _pending() & ~F.coalesce("approved", F.lit(False)) if "approved" in clusters.columns else _pending(), "resolved": F.col("status") == "resolved", "fanin": F.col("members") >= C.FAN_IN_MEMBERS}
    return clusters.filter(tests[name])


def by_unit(records: DataFrame, clusters: DataFrame, unit: str) -> DataFrame:
    """The families that hold a unit's records, with how many, most first."""
    own = records.filter(F.col("cpse") == unit).groupBy("family_no").agg(F.count(F.lit(1)).alias("n_records"))
    return clusters.join(own, "family_no").orderBy(F.desc("n_records"), "family_no")


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page of ``rows`` with the total and whether more follow."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    shown = rows.orderBy(*order).offset(offset).limit(limit)
    return shown.join(total).withColumn("has_more", F.col("total") > offset + limit)  # a table of one row


def spelling_counts(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """Families with ``n_spellings``; 0 for one without records."""
    n = records.groupBy("family_no").agg(F.countDistinct(T.squeezed(F.col("description"))).alias("n_spellings"))
    return clusters.join(n, "family_no", "left").fillna(0, ["n_spellings"])


#: Orders of the provenance list: a column, whether its greatest comes first; ties go by number.
ORDERS = {"code": ("family_no", False), "records": ("members", True), "spellings": ("n_spellings", True), "score": ("score", False)}


def provenance(records: DataFrame, clusters: DataFrame, word: str = "", sort: str = "code", offset: int = 0, limit: int = 25, shown: int = C.PAGE_SPELLINGS) -> DataFrame:
    """A page of families, each with its first spellings: the golden one, then those of most records."""
    column, down = ORDERS[sort]
    families_ = page(spelling_counts(records, with_status(holds(records, clusters, word))), [F.desc(column) if down else F.asc(column), "family_no"], offset, limit)
    # The page is cut first, so that spellings are gathered for its families only.
    own = runs.spellings(records.join(families_.select("family_no"), "family_no", "left_semi"))
    turn = Window.partitionBy("family_no").orderBy(F.desc("is_golden"), F.desc("n_records"), "first_row")
    few = own.withColumn("place", F.row_number().over(turn)).filter(F.col("place") <= shown)
    rows = families_.select("family_no", "n_spellings", "total", "has_more").join(few, "family_no")
    return rows.withColumn("hidden", F.greatest(F.col("n_spellings") - shown, F.lit(0)))


def evaluation(records: DataFrame) -> DataFrame:
    """One row: labelled and unlabelled records, items by label and by family, pair counts and scores; null where undefined."""
    known = labelled(records)
    pairs = lambda: F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long"))
    count = F.count(F.lit(1)).alias("n")
    tp = known.groupBy("label", "family_no").agg(count).agg(pairs().alias("tp"))
    truth = known.groupBy("label").agg(count).agg(pairs().alias("t"), F.count(F.lit(1)).alias("true_items"))
    found = known.groupBy("family_no").agg(count).agg(pairs().alias("p"), F.count(F.lit(1)).alias("predicted_items"))
    size = known.agg(count).select(F.col("n").alias("labelled"), (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"))
    one = tp.join(truth).join(found).join(size).join(records.agg(count))  # five tables of one row
    over = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    c = F.col
    precision, recall = over(c("tp"), c("p")), over(c("tp"), c("t"))
    chance = over(c("t") * c("p").cast("double"), c("pairs"))
    rand = over(c("tp") - chance, (c("t") + c("p")) / 2 - chance)
    said = F.when(c("predicted_items") > c("true_items"), F.format_string("%d items where the labels say %d: it splits too much.", "predicted_items", "true_items"))
    said = said.when(c("predicted_items") < c("true_items"), F.format_string("%d items where the labels say %d: it merges what the labels keep apart.", "predicted_items", "true_items"))
    said = said.otherwise(F.format_string("exactly the %d items of the labels.", "true_items"))
    reading = F.concat(F.format_string("%.1f%% of its merges are right, and it found %.1f%% of the pairs there are; ", F.round(precision * 100, 1), F.round(recall * 100, 1)), said)
    return one.select(
        "labelled", (c("n") - c("labelled")).alias("unlabelled"), "true_items", "predicted_items", "pairs", "tp", (c("p") - c("tp")).alias("fp"), (c("t") - c("tp")).alias("fn"),
        F.round(precision, 4).alias("prec"), F.round(recall, 4).alias("recall"), F.round(over(2 * c("tp"), c("t") + c("p")), 4).alias("f1"), F.round(rand, 4).alias("adjusted_rand"), F.coalesce(reading, F.lit("too few labelled pairs")).alias("reading"),
    )


def mistakes(records: DataFrame, by: str, other: str) -> DataFrame:
    """The six largest groups of ``by`` that hold more than one ``other``, with four samples of each."""
    known = labelled(records)
    wrong = known.groupBy(by).agg(F.countDistinct(other).alias("parts"), F.count(F.lit(1)).alias("n_records")).filter("parts > 1").orderBy(F.desc("n_records"), by).limit(C.EXAMPLES)
    turn = Window.partitionBy(by).orderBy("row_id")
    some = known.join(F.broadcast(wrong), by).withColumn("k", F.row_number().over(turn)).filter(F.col("k") <= C.EXAMPLE_SAMPLES)  # six rows
    cell = F.concat(F.col(other).cast("string"), F.lit(": "), F.left("description", F.lit(C.EXAMPLE_LENGTH)))
    samples = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", cell.alias("s")))), lambda x: x["s"]), "|")
    return some.groupBy(F.col(by).cast("string").alias("name"), "parts", "n_records").agg(samples.alias("samples"))


def code_scheme(proposed: DataFrame) -> DataFrame:
    """One row: classes, the twelve largest as NAME:count, families in the fallback class, and families with a code."""
    per = proposed.filter("proposed_code <> ''").groupBy(F.element_at(F.split("proposed_code", "-"), 2).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    top = per.orderBy(F.desc("n"), "c").limit(C.SHOWN_CLASSES).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "c", "n"))), lambda x: F.concat(x["c"], F.lit(":"), x["n"].cast("string"))), "|").alias("largest"))
    sums = per.agg(F.count(F.lit(1)).alias("classes"), F.coalesce(F.sum(F.when(F.col("c") == C.CODE_FALLBACK, F.col("n"))), F.lit(0)).alias("generic"), F.coalesce(F.sum("n"), F.lit(0)).alias("coded"))
    return sums.join(top)  # two tables of one row


def uom_report(raw: DataFrame) -> DataFrame:
    """One row for a column ``raw`` of units of measure: forms as written and folded, what folding saved, and the unknown ones."""
    seen = raw.select(T.uom_cleaned(F.col("raw")).alias("form"), T.uom(F.col("raw")).alias("u")).groupBy("form", "u.canonical", "u.dimension").agg(F.count(F.lit(1)).alias("n"))
    unknown = seen.filter((F.col("dimension") == C.UNKNOWN) & (F.col("canonical") != C.UNSPECIFIED)).groupBy("canonical").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "canonical").limit(C.UNRECOGNISED_UNITS)
    listed = unknown.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "canonical", "n"))), lambda x: F.concat(x["canonical"], F.lit(":"), x["n"].cast("string"))), "|").alias("unrecognised"))
    sums = seen.agg(F.countDistinct("form").alias("raw_forms"), F.countDistinct("canonical").alias("canonical_forms"), F.countDistinct("dimension").alias("dimensions"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    return sums.join(listed).withColumn("collapsed", F.greatest(F.col("raw_forms") - F.col("canonical_forms"), F.lit(0)))  # two tables of one row


def near_goldens(clusters: DataFrame) -> DataFrame:
    """The 36 closest pairs of families whose golden texts nearly merged: cosine from .55 up to .75."""
    grams = S.trigrams(clusters.select(F.col("family_no").alias("id"), F.col("golden").alias("text")))
    near = S.sparse_edges(grams, round(C.NEAR_MISS_LOW * 20), 20).filter((F.col("i") < F.col("j")) & (F.col("cos") < C.NEAR_MISS_HIGH))
    return near.orderBy(F.desc("cos"), F.desc("i"), F.desc("j")).limit(C.NEAR_MISSES).select(F.col("i").alias("left_no"), F.col("j").alias("right_no"), F.round("cos", 4).alias("cos"))


def simulate(records: DataFrame, clusters: DataFrame, probes: DataFrame) -> DataFrame:
    """What would become of each probe (id, description): its normal form, the nearest family and how near, and records that read alike already."""
    told = probes.select("id", T.normalize(F.col("description")).alias("text"), F.size(T.trace(F.col("description"))).alias("n_steps"))
    best = assign.assign(probes.select(F.col("id").alias("row_id"), "description"), clusters).select(F.col("row_id").alias("id"), "family_no", F.coalesce("score", F.lit(0.0)).alias("score"), "merges")
    here = records.join(told.select("text").distinct(), "text", "left_semi").groupBy("text").agg(F.count(F.lit(1)).alias("already"))
    whole = told.join(best, "id").join(here, "text", "left").fillna(0, ["already"])
    return whole.select("id", "text", "n_steps", F.when(F.col("merges"), F.col("family_no")).alias("family_no"), "score", T.confidence(F.col("score")).alias("confidence"), T.status(F.col("score")).alias("band"), "merges", "already")


def spelling_rows(records: DataFrame, family_no: int, spelling: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """The records of one spelling of a family, by owner and code."""
    own = records.filter((F.col("family_no") == family_no) & (T.squeezed(F.col("description")) == spelling))
    return page(own, ["cpse", "code", "row_id"], offset, limit)


# -- the queries


def run_stats(spark, d):
    return stats(*families(spark, d))


def family_distribution(spark, d):
    return distribution(families(spark, d)[1])


def sweep_accuracy(spark, d):
    return sweep(*families(spark, d))


def orders_as_records(spark, d):
    """Orders as priced records: fifty families, an owner for each priority, two units of measure."""
    o = read(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("row_id"), (F.col("o_custkey") % 50).alias("family_no"), F.col("o_orderpriority").alias("cpse"), F.when(F.col("o_orderkey") % 7 == 0, "KG").otherwise("EACH").alias("uom"),
        F.when(F.col("o_orderkey") % 11 > 0, F.floor("o_totalprice").cast("double") * (1 + F.length("o_orderpriority") % 3)).otherwise(0.0).alias("price"),
    )


def worst_unit_orders(spark, d):
    return worst_units(orders_as_records(spark, d))


def unit_medians_orders(spark, d):
    return unit_medians_of(orders_as_records(spark, d)).select("family_no", "cpse", "n", F.round("median", 2).alias("median"), F.round("raw_ratio", 3).alias("ratio"))


def price_details_orders(spark, d):
    """The price block of each family beside the medians of its owners."""
    rows = price_details(orders_as_records(spark, d)).select("family_no", "priced", "price_median", "price_spread", "outlier_unit", "outlier_ratio", F.posexplode("unit_medians").alias("place", "u"))
    return rows.select("family_no", "priced", "price_median", "price_spread", "outlier_unit", "outlier_ratio", (F.col("place") + 1).cast("long").alias("place"), "u.unit", "u.median", "u.records", "u.ratio")


def savings_orders(spark, d):
    return savings(orders_as_records(spark, d))


def top_savings_orders(spark, d):
    return top_savings(orders_as_records(spark, d))


def uom_list_orders(spark, d):
    return unit_list(orders_as_records(spark, d).filter("price > 0"))


def savings_report(spark, d):
    return savings(families(spark, d)[0])


def search_everywhere(spark, d):
    """Families found by a word in a golden text, a code, a member's text or a member's own code."""
    records, clusters = families(spark, d)
    words = (WORD, "mtl-000001", "p-19")
    found = [holds(records, clusters, w).select(F.lit(w).alias("word"), "family_no", "members") for w in words]
    return found[0].unionByName(found[1]).unionByName(found[2])


def view_pages(spark, d):
    """The second page of ten of each view."""
    clusters = with_status(families(spark, d)[1])
    pages = [page(view(clusters, v), ["family_no"], 10, 10).select(F.lit(v).alias("view"), "family_no", "members", "status", "total", "has_more") for v in ("all", "review", "resolved", "fanin")]
    return pages[0].unionByName(pages[1]).unionByName(pages[2]).unionByName(pages[3])


def unit_ranked(spark, d):
    """The twenty families in which a unit has most records."""
    records, clusters = families(spark, d)
    return by_unit(records, clusters, UNIT).limit(20).select("family_no", "n_records", "members")


def _shown(rows):
    return rows.select("family_no", "place", "spelling", "n_records", "lowest", F.array_join("units", "|").alias("units"), F.array_join("codes", "|").alias("codes"), "sample", "is_golden", "n_spellings", "hidden", "total", "has_more")


def provenance_by_spellings(spark, d):
    """The families written in most ways."""
    return _shown(provenance(*families(spark, d), sort="spellings"))


def provenance_by_score(spark, d):
    """The families of a word with the lowest scores, four spellings each."""
    return _shown(provenance(*families(spark, d), word=WORD, sort="score", offset=2, limit=10, shown=4))


def provenance_totals(spark, d):
    """Families, records and distinct spellings of the run."""
    records, clusters = families(spark, d)
    n = records.agg(F.count(F.lit(1)).alias("records"), F.countDistinct(T.squeezed(F.col("description"))).alias("spellings"))
    return clusters.agg(F.count(F.lit(1)).alias("families")).join(n)  # two tables of one row


def eval_report(spark, d):
    """The evaluation where every fifth record has no label."""
    return evaluation(families(spark, d)[0].withColumn("label", F.when(F.col("row_id") % 5 == 0, " ").otherwise(F.col("label"))))


def eval_wrong_merges(spark, d):
    return mistakes(families(spark, d)[0], "family_no", "label")


def eval_missed_merges(spark, d):
    return mistakes(families(spark, d)[0], "label", "family_no")


def code_scheme_report(spark, d):
    return code_scheme(codes.propose(families(spark, d)[1]))


def _dirty(spark, d):
    unit = F.element_at(F.array(*[F.lit(u) for u in DIRTY_UNITS]), (F.col("p_partkey") * F.col("p_size") % len(DIRTY_UNITS)).cast("int") + 1)
    return read(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 31 > 0, unit).alias("raw"))


def uom_dirty(spark, d):
    """Units of measure as people write them, folded."""
    return _dirty(spark, d).select("p_partkey", T.uom(F.col("raw")).alias("u")).select("p_partkey", "u.canonical", "u.dimension")


def uom_dirty_report(spark, d):
    return uom_report(_dirty(spark, d))


def approve_preview(spark, d):
    """What approving each family would sign off, and how many doubts there are."""
    records, clusters = families(spark, d)
    rows = spelling_counts(records, with_status(clusters))
    shown = F.least(F.col("n_spellings"), F.lit(C.PREVIEW_SPELLINGS))
    doubts = (F.col("mean") < C.ACCEPT_FLOOR).cast("int") + (shown > C.MANY_SPELLINGS).cast("int")
    return rows.select("family_no", "golden", "members", "units", "score", "status", (F.col("n_spellings") - shown).alias("more"), doubts.alias("concerns"))


def merge_preview(spark, d):
    """What a merge of the first two families would make."""
    plan = decisions.fresh_run(spark, d).merge_plan(1, 2)
    fields = ("keeps", "absorbed", "golden", "golden_from", "records", "units", "spellings", "retires")
    return spark.createDataFrame([tuple(plan[f] for f in fields)], "keeps long, absorbed long, golden string, golden_from string, records long, units long, spellings long, retires string")


PROBES = ("red bolt, economy", "BOLT", "zzz;qqq")


def simulate_probes(spark, d):
    """Made-up descriptions, and ten that are in the run."""
    records, clusters = families(spark, d)
    made = spark.createDataFrame([(-i, p) for i, p in enumerate(PROBES, 1)], "id long, description string")
    known = read(spark, d, "part").filter("p_partkey <= 10").select(F.col("p_partkey").alias("id"), F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("description"))
    return simulate(records, clusters, made.unionByName(known))


def provenance_rows(spark, d):
    """The second ten records of the most frequent spelling of the first family."""
    records, _ = families(spark, d)
    top = runs.spellings(records.filter("family_no = 1")).orderBy(F.desc("n_records"), "first_row").first()
    return spelling_rows(records, 1, top["spelling"], 10, 10).select("row_id", "cpse", "code", "score", "total", "has_more")


def near_miss_goldens(spark, d):
    return near_goldens(families(spark, d)[1])


def family_fingerprints(spark, d):
    """The key under which a model's answer for a family is kept."""
    records, _ = families(spark, d)
    ways = records.select("family_no", "golden", "description").distinct()
    first = F.row_number().over(Window.partitionBy("family_no").orderBy("description"))  # Spark keeps so many rows a family before the shuffle
    few = ways.withColumn("k", first).filter(F.col("k") <= C.ASKED_LINES).groupBy("family_no", "golden").agg(F.collect_list("description").alias("ways"))
    return few.select("family_no", enrich.fingerprint(F.col("golden"), F.col("ways")).alias("fingerprint"))


def control_characters(spark, d):
    raw = F.concat(F.lit(" "), F.col("p_name"), F.lit("\u0007\t \n"), F.col("p_type"), F.lit("\u007f x\u0001"))
    return read(spark, d, "part").select("p_partkey", T.stripped(raw).alias("cleaned"))


def price_dirty(spark, d):
    """Prices as people write them."""
    forms = [F.format_string("Rs %.2f", "o_totalprice"), F.format_number("o_totalprice", 2), F.concat(F.lit("Rs."), F.format_number(F.floor("o_totalprice"), 0)), F.lit("12-3"), F.lit("n/a"), F.concat(F.lit("-"), F.format_string("%.1f", "o_totalprice"))]
    raw = F.element_at(F.array(*forms), (F.col("o_orderkey") % len(forms)).cast("int") + 1)
    return read(spark, d, "orders").select("o_orderkey", T.parse_price(raw).alias("price"))


QUERIES = {
    f.__name__: f
    for f in (
        run_stats, family_distribution, sweep_accuracy, worst_unit_orders, unit_medians_orders, price_details_orders, savings_orders, top_savings_orders, uom_list_orders, savings_report, search_everywhere, view_pages, unit_ranked,
        provenance_by_spellings, provenance_by_score, provenance_totals, eval_report, eval_wrong_merges, eval_missed_merges, code_scheme_report, uom_dirty, uom_dirty_report, approve_preview, near_miss_goldens,
        family_fingerprints, control_characters, price_dirty, merge_preview, simulate_probes, provenance_rows,
    )
}

_ST = f"st AS (SELECT *, {O._STATUS} status, round(mean, 4) score FROM c)"
_N = "count(*) FILTER (status = '{s}')"
_ORD = "ro AS (SELECT o_orderkey row_id, o_custkey % 50 family_no, o_orderpriority cpse, CASE WHEN o_orderkey % 7 = 0 THEN 'KG' ELSE 'EACH' END uom, CASE WHEN o_orderkey % 11 > 0 THEN floor(o_totalprice) * (1 + length(o_orderpriority) % 3) ELSE 0 END price FROM orders)"
#: The steps of the price block and the owners' medians over records ``{r}``.
_MONEY = """pr AS (SELECT * FROM {r} WHERE price > 0), pe AS (SELECT family_no, uom, count(*) n, min(row_id) first FROM pr GROUP BY 1, 2),
ba AS (SELECT family_no, arg_max(uom, (n, -first)) basis_uom FROM pe GROUP BY 1), ins AS (SELECT pr.* FROM pr JOIN ba ON pr.family_no = ba.family_no AND pr.uom = ba.basis_uom),
bl AS (SELECT family_no, count(*) priced, sum(price) spend, min(price) low, max(price) high, median(price) mid FROM ins GROUP BY 1),
bx AS (SELECT ins.family_no, sum(greatest(price - mid, 0)) excess FROM ins JOIN bl USING (family_no) GROUP BY 1),
um AS (SELECT ins.family_no, cpse, count(*) n, median(price) med, median(price) / any_value(mid) ratio, min(row_id) fr, sum(greatest(price - mid, 0)) x FROM ins JOIN bl USING (family_no) GROUP BY 1, 2 HAVING count(*) >= 5),
wu AS (SELECT family_no, cpse outlier_unit, round(ratio, 3) outlier_ratio, round(x, 2) outlier_excess FROM (SELECT *, row_number() OVER (PARTITION BY family_no ORDER BY ratio DESC, fr) k FROM um WHERE ratio > 1) WHERE k = 1),
mo AS (SELECT family_no, priced, round(spend, 2) spend, round(excess, 2) excess, round(spend - low * priced, 2) savings, round(high / low, 2) price_spread, outlier_unit, outlier_ratio, outlier_excess FROM bl JOIN bx USING (family_no) LEFT JOIN wu USING (family_no))"""
_TOTALS = """SELECT count(*) families, round(sum(spend), 1) spend, round(sum(excess), 1) excess_over_median, round(100 * sum(excess) / sum(spend), 2) excess_pct, round(sum(savings), 1) against_best_price,
round(100 * sum(savings) / sum(spend), 2) best_pct, sum(priced)::BIGINT priced_records, ((SELECT count(*) FROM {r}) - sum(priced))::BIGINT unpriced_records, count(*) FILTER (outlier_ratio > 1.25) outlier_families,
round(coalesce(sum(outlier_excess) FILTER (outlier_ratio > 1.25), 0), 1) outlier_excess FROM mo"""
_HIT = "SELECT '{w}' word, family_no, members FROM c WHERE contains(lower(golden), '{w}') OR contains('mtl-' || lpad(family_no::VARCHAR, 7, '0'), '{w}') OR family_no IN (SELECT family_no FROM r WHERE contains(lower(description), '{w}') OR contains(lower(code), '{w}'))"
#: Spellings of every family, and the families with how many they have.
_SPELL = """ky AS (SELECT *, upper(description) spelling FROM r), ns AS (SELECT family_no, count(DISTINCT spelling) n_spellings FROM ky GROUP BY 1),
cs AS (SELECT st.*, n_spellings FROM st JOIN ns USING (family_no)),
uu AS (SELECT family_no, spelling, string_agg(cpse, '|' ORDER BY met) units FROM (SELECT family_no, spelling, cpse, min(row_id) met FROM ky GROUP BY 1, 2, 3) GROUP BY 1, 2),
cc AS (SELECT family_no, spelling, string_agg(code, '|' ORDER BY row_id) codes FROM (SELECT *, row_number() OVER (PARTITION BY family_no, spelling ORDER BY row_id) k FROM ky WHERE code <> '') WHERE k <= 3 GROUP BY 1, 2),
sp AS (SELECT family_no, spelling, count(*) n_records, min(score) lowest, min(row_id) fr, left(arg_min(description, row_id), 160) sample, arg_min(text = golden, row_id) is_golden FROM ky GROUP BY 1, 2),
pl AS (SELECT *, (row_number() OVER (PARTITION BY family_no ORDER BY is_golden DESC, n_records DESC, fr))::INT place FROM sp)"""
_PAGE = """SELECT family_no, place, spelling, n_records, pl.lowest, coalesce(uu.units, '') units, coalesce(codes, '') codes, sample, is_golden, n_spellings, greatest(n_spellings - {shown}, 0) hidden, total, total > {upto} has_more
FROM pg JOIN pl USING (family_no) LEFT JOIN uu USING (family_no, spelling) LEFT JOIN cc USING (family_no, spelling) WHERE place <= {shown}"""
_MISTAKES = """, wr AS (SELECT {by}::VARCHAR name, {by} b, count(DISTINCT {other}) parts, count(*) n_records FROM r GROUP BY ALL HAVING count(DISTINCT {other}) > 1 ORDER BY n_records DESC, b LIMIT 6),
sm AS (SELECT {by} b, {other} || ': ' || left(description, 110) s, row_number() OVER (PARTITION BY {by} ORDER BY row_id) k FROM r)
SELECT name, parts, n_records, string_agg(s, '|' ORDER BY k) samples FROM wr JOIN sm USING (b) WHERE k <= 4 GROUP BY 1, 2, 3"""
_LOOKUP = ", ".join(f"('{name.replace(chr(39), chr(39) * 2)}', '{unit}', '{dim}')" for name, unit, dim in {n: (n, u, d) for d, u, names in C.UOM_TABLE for n in dict.fromkeys([*names.split(), u])}.values())
_QUOTE = lambda s: "'" + s.replace("'", "''") + "'"
#: Units of measure folded in steps: cleaned, as it is, singular, without leading digits, both.
_UOM = f"""lk(name, unit, dim) AS (VALUES {_LOOKUP}),
rw AS (SELECT p_partkey, CASE WHEN p_partkey % 31 > 0 THEN [{', '.join(map(_QUOTE, DIRTY_UNITS))}][p_partkey * p_size % {len(DIRTY_UNITS)} + 1] END raw FROM part),
cl AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(upper(trim(coalesce(raw, ''))), '[\\s._/\\\\-]+', '', 'g'), '[''()]', '', 'g'), '^[#!]+|[#!]+$', '', 'g') f FROM rw),
c2 AS (SELECT *, CASE WHEN length(f) > 2 AND f LIKE '%S' THEN left(f, -1) END f1, nullif(regexp_replace(f, '^[0-9]+', ''), '') f2 FROM cl),
c3 AS (SELECT *, CASE WHEN f2 <> f THEN f2 END f3, CASE WHEN f2 <> f AND f2 LIKE '%S' THEN left(f2, -1) END f4 FROM c2),
uo AS (SELECT c3.*, f IN ({', '.join(map(_QUOTE, C.UOM_BLANKS))}) blank, coalesce(a.unit, b.unit, c.unit, e.unit, f) u, coalesce(a.dim, b.dim, c.dim, e.dim, 'unknown') di
  FROM c3 LEFT JOIN lk a ON a.name = f LEFT JOIN lk b ON b.name = f1 LEFT JOIN lk c ON c.name = f3 LEFT JOIN lk e ON e.name = f4),
un AS (SELECT p_partkey, f, CASE WHEN blank THEN 'UNSPECIFIED' ELSE u END canonical, CASE WHEN blank THEN 'unknown' ELSE di END dimension FROM uo)"""
_LISTED = "string_agg({c} || ':' || n, '|' ORDER BY n DESC, {c})"
_CODED = """x AS (SELECT split_part(proposed_code, '-', 2) c, count(*) n FROM ({codes}) GROUP BY 1), y AS (SELECT * FROM x ORDER BY n DESC, c LIMIT 12)"""

ORACLE = {
    "run_stats": f"WITH {O._FAM}, {_ST} SELECT sum(members)::BIGINT records, count(*) families, (sum(members) - count(*))::BIGINT collapsed, round(sum(members) / count(*), 2) fan_in, count(*) FILTER (status IN ('review', 'conflict')) review_families, {', '.join(_N.format(s=s) + ' ' + s for s in _STATUSES)}, (SELECT count(*) FROM r WHERE cpse = 'UNSPECIFIED') unspecified FROM st",
    "family_distribution": f"WITH {O._FAM}, {_ST} SELECT {', '.join(f'round(100.0::DOUBLE * {_N.format(s=s)} / count(*), 1) {s}_pct' for s in _STATUSES)}, count(*) view_all, count(*) FILTER (status IN ('review', 'conflict')) view_review, {_N.format(s='resolved')} view_resolved, count(*) FILTER (members >= 4) view_fanin FROM st",
    "sweep_accuracy": f"""WITH {O._FAM}, pu AS (SELECT family_no, count(DISTINCT label) = 1 pure FROM r GROUP BY 1), fl AS (SELECT (x / 100.0)::DECIMAL(4,2) fl FROM range(55, 100) v(x)), zz AS (SELECT fl, m >= fl AS auto, members, pure FROM fl, (SELECT round(mean, 4)::DECIMAL(6,4) m, members, pure FROM c JOIN pu USING (family_no)))
      SELECT fl::DOUBLE AS floor, count(*) FILTER (auto) AS auto, count(*) FILTER (NOT auto) review, coalesce(sum(members) FILTER (NOT auto), 0)::BIGINT review_records, round(count(*) FILTER (auto) / count(*), 4) auto_share, count(*) FILTER (auto) auto_judged,
      round(count(*) FILTER (auto AND pure) / nullif(count(*) FILTER (auto), 0), 4) auto_correct, count(*) FILTER (NOT auto AND NOT pure) wrong_caught, count(*) FILTER (auto AND NOT pure) wrong_shipped FROM zz GROUP BY fl""",
    "worst_unit_orders": f"WITH {_ORD}, {_MONEY.format(r='ro')} SELECT * FROM wu",
    "price_details_orders": f"WITH {_ORD}, {_MONEY.format(r='ro')} SELECT family_no, priced, round(mid, 4) price_median, price_spread, outlier_unit, outlier_ratio, row_number() OVER (PARTITION BY family_no ORDER BY ratio DESC, cpse) place, cpse AS unit, round(med, 2) median, n AS records, round(ratio, 3) ratio FROM um JOIN mo USING (family_no) JOIN (SELECT family_no, mid FROM bl) USING (family_no)",
    "unit_medians_orders": f"WITH {_ORD}, {_MONEY.format(r='ro')} SELECT family_no, cpse, n, round(med, 2) median, round(ratio, 3) ratio FROM um",
    "savings_orders": f"WITH {_ORD}, {_MONEY.format(r='ro')} {_TOTALS.format(r='ro')}",
    "top_savings_orders": f"WITH {_ORD}, {_MONEY.format(r='ro')} SELECT * EXCLUDE (priced) FROM mo ORDER BY excess DESC, family_no LIMIT 25",
    "uom_list_orders": f"WITH {_ORD}, pe AS (SELECT family_no, uom, count(*) n, min(row_id) fr FROM ro WHERE price > 0 GROUP BY 1, 2) SELECT family_no, string_agg(uom || ':' || n, '|' ORDER BY n DESC, fr) uom_list FROM pe GROUP BY 1",
    "savings_report": f"WITH {O._FAM}, {_MONEY.format(r='r')} {_TOTALS.format(r='r')}",
    "search_everywhere": f"WITH {O._FAM} " + " UNION ALL ".join(_HIT.format(w=w) for w in (WORD, "mtl-000001", "p-19")),
    "view_pages": f"WITH {O._FAM}, {_ST} " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{v}' AS view, family_no, members, status, count(*) OVER () total, count(*) OVER () > 20 has_more FROM st WHERE {t} ORDER BY family_no LIMIT 10 OFFSET 10)" for v, t in (("all", "true"), ("review", "status IN ('review', 'conflict')"), ("resolved", "status = 'resolved'"), ("fanin", "members >= 4"))),
    "unit_ranked": f"WITH {O._FAM} SELECT family_no, count(*) FILTER (cpse = '{UNIT}') n_records, count(*) members FROM r GROUP BY 1 HAVING n_records > 0 ORDER BY n_records DESC, family_no LIMIT 20",
    "provenance_by_spellings": f"WITH {O._FAM}, {_ST}, {_SPELL}, pg AS (SELECT *, count(*) OVER () total FROM cs ORDER BY n_spellings DESC, family_no LIMIT 25) {_PAGE.format(shown=C.PAGE_SPELLINGS, upto=25)}",
    "provenance_by_score": f"WITH {O._FAM}, {_ST}, {_SPELL}, pg AS (SELECT *, count(*) OVER () total FROM cs WHERE family_no IN (SELECT family_no FROM ({_HIT.format(w=WORD)})) ORDER BY score, family_no LIMIT 10 OFFSET 2) {_PAGE.format(shown=4, upto=12)}",
    "provenance_totals": f"WITH {O._FAM} SELECT count(DISTINCT family_no) families, count(*) records, count(DISTINCT upper(description)) spellings FROM r",
    "eval_report": f"""WITH {O._FAM}, k AS (SELECT * FROM r WHERE row_id % 5 <> 0), x AS (SELECT (SELECT count(*) FROM k) labelled, (SELECT count(*) FROM r) n, (SELECT count(DISTINCT label) FROM k) true_items, (SELECT count(DISTINCT family_no) FROM k) predicted_items,
      (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) n FROM k GROUP BY label, family_no))::BIGINT tp, (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) n FROM k GROUP BY label))::BIGINT t, (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) n FROM k GROUP BY family_no))::BIGINT p),
      y AS (SELECT *, labelled * (labelled - 1) // 2 pairs, t * p::DOUBLE / (labelled * (labelled - 1) // 2) chance FROM x)
      SELECT labelled, n - labelled unlabelled, true_items, predicted_items, pairs, tp, p - tp fp, t - tp fn, round(tp / p, 4) prec, round(tp / t, 4) recall, round(2 * tp / (t + p), 4) f1, round((tp - chance) / ((t + p) / 2 - chance), 4) adjusted_rand,
      printf('%.1f%% of its merges are right, and it found %.1f%% of the pairs there are; ', round(100 * tp / p, 1), round(100 * tp / t, 1)) || CASE WHEN predicted_items > true_items THEN printf('%d items where the labels say %d: it splits too much.', predicted_items, true_items)
      WHEN predicted_items < true_items THEN printf('%d items where the labels say %d: it merges what the labels keep apart.', predicted_items, true_items) ELSE printf('exactly the %d items of the labels.', true_items) END reading FROM y""",
    "eval_wrong_merges": f"WITH {O._FAM}" + _MISTAKES.format(by="family_no", other="label"),
    "eval_missed_merges": f"WITH {O._FAM}" + _MISTAKES.format(by="label", other="family_no"),
    "code_scheme_report": f"WITH {_CODED.format(codes=_REVIEW['proposed_codes'])} SELECT count(*) classes, coalesce(sum(n) FILTER (c = 'GEN'), 0)::BIGINT generic, sum(n)::BIGINT coded, (SELECT {_LISTED.format(c='c')} FROM y) largest FROM x",
    "uom_dirty": f"WITH {_UOM} SELECT p_partkey, canonical, dimension FROM un",
    "uom_dirty_report": f"""WITH {_UOM}, unk AS (SELECT canonical, count(*) n FROM un WHERE dimension = 'unknown' AND canonical <> 'UNSPECIFIED' GROUP BY 1 ORDER BY n DESC, canonical LIMIT 12)
      SELECT count(DISTINCT f) raw_forms, count(DISTINCT canonical) canonical_forms, count(DISTINCT dimension) dimensions, count(*) n_rows, (SELECT {_LISTED.format(c='canonical')} FROM unk) unrecognised, greatest(count(DISTINCT f) - count(DISTINCT canonical), 0) collapsed FROM un""",
    "approve_preview": f"WITH {O._FAM}, {_ST}, ns AS (SELECT family_no, count(DISTINCT upper(description)) n FROM r GROUP BY 1) SELECT family_no, golden, members, units, score, status, greatest(n - 12, 0) AS more, (mean < 0.82)::INT + (n > 6)::INT concerns FROM st JOIN ns USING (family_no)",
    "merge_preview": f"""WITH {O._FAM}, sz AS (SELECT (SELECT members FROM c WHERE family_no = 1) m1, (SELECT members FROM c WHERE family_no = 2) m2), kp AS (SELECT CASE WHEN m2 > m1 THEN 2 ELSE 1 END kn FROM sz), bo AS (SELECT * FROM r WHERE family_no IN (1, 2)),
      gn AS (SELECT arg_max(text, (length(text), family_no = kn, score, -row_id)) gt FROM bo CROSS JOIN kp)
      SELECT any_value(kn)::BIGINT keeps, 3 - any_value(kn)::BIGINT absorbed, any_value(gt) golden, CASE any_value(gt) WHEN (SELECT golden FROM c, kp WHERE family_no = kn) THEN 'keeps' WHEN (SELECT golden FROM c, kp WHERE family_no = 3 - kn) THEN 'absorbed' ELSE 'members' END golden_from,
      count(*) records, count(DISTINCT cpse) units, count(DISTINCT upper(description)) spellings, 'MTL-' || lpad((3 - any_value(kn))::VARCHAR, 7, '0') retires FROM bo, kp, gn""",
    "simulate_probes": f"""WITH {O._FAM}, pb(id, text, n_steps) AS (VALUES (-1, 'RED BOLT ECONOMY', 2), (-2, 'BOLT', 0), (-3, 'ZZZ QQQ', 2) UNION ALL SELECT p_partkey, upper(p_name || ' ' || p_type), CASE WHEN lower(p_name || ' ' || p_type) <> upper(p_name || ' ' || p_type) THEN 1 ELSE 0 END FROM part WHERE p_partkey <= 10),
      p0 AS (SELECT id, gram, count(*) n FROM (SELECT id, unnest(list_transform(range(1, length(text) + 1), lambda i: substr(' ' || text || ' ', i, 3))) gram FROM pb) GROUP BY 1, 2), p1 AS (SELECT *, sum(n * n) OVER (PARTITION BY id) qn FROM p0),
      fg AS (SELECT family_no, q.gram, q.n nf, q.q qf FROM gd JOIN q ON q.id = gd.gid), dd AS (SELECT id, family_no, sum(n * nf) / sqrt((any_value(qn) * any_value(qf))::DOUBLE) cos FROM p1 JOIN fg USING (gram) GROUP BY 1, 2),
      bb AS (SELECT id, arg_max(family_no, (cos, -family_no)) fno, max(cos) cos FROM dd GROUP BY 1), ff AS (SELECT pb.*, fno, coalesce(round(cos, 4), 0) score, coalesce(cos >= 0.75, false) merges FROM pb LEFT JOIN bb USING (id))
      SELECT id::BIGINT id, text, n_steps, CASE WHEN merges THEN fno END family_no, score, CASE WHEN score >= 0.9 THEN 'HIGH' WHEN score >= 0.75 THEN 'MEDIUM' ELSE 'LOW' END confidence, CASE WHEN score >= 0.95 THEN 'resolved' WHEN score >= 0.82 THEN 'accepted' WHEN score >= 0.75 THEN 'review' ELSE 'conflict' END band,
      merges, (SELECT count(*) FROM r WHERE r.text = ff.text) already FROM ff""",
    "provenance_rows": f"""WITH {O._FAM}, k AS (SELECT upper(description) sp FROM r WHERE family_no = 1 GROUP BY 1 ORDER BY count(*) DESC, min(row_id) LIMIT 1)
      SELECT row_id, cpse, code, score, count(*) OVER () total, count(*) OVER () > 20 has_more FROM r, k WHERE family_no = 1 AND upper(description) = sp ORDER BY cpse, code, row_id LIMIT 10 OFFSET 10""",
    "near_miss_goldens": f"""WITH {O._FAM} SELECT a.family_no left_no, b.family_no right_no, round(dot / sqrt((qa * qb)::DOUBLE), 4) cos FROM gd a JOIN gd b ON a.family_no < b.family_no JOIN dots ON dots.i = a.gid AND dots.j = b.gid
      WHERE 400 * dot * dot >= 121 * qa * qb AND dot / sqrt((qa * qb)::DOUBLE) < 0.75 ORDER BY dot / sqrt((qa * qb)::DOUBLE) DESC, 1 DESC, 2 DESC LIMIT 36""",
    "family_fingerprints": f"""WITH {O._FAM}, wy AS (SELECT family_no, golden, description w, row_number() OVER (PARTITION BY family_no ORDER BY description) k FROM (SELECT DISTINCT family_no, golden, description FROM r))
      SELECT family_no, left(sha1('[' || to_json(golden)::VARCHAR || ', [' || string_agg(to_json(w)::VARCHAR, ', ' ORDER BY w) || ']]'), 16) fingerprint FROM wy WHERE k <= 8 GROUP BY family_no, golden""",
    "control_characters": "SELECT p_partkey, trim(regexp_replace(regexp_replace(' ' || p_name || chr(7) || chr(9) || ' ' || chr(10) || p_type || chr(127) || ' x' || chr(1), '\\s+', ' ', 'g'), '[\\x00-\\x1f\\x7f]', ' ', 'g')) cleaned FROM part",
    "price_dirty": "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN round(o_totalprice, 2) WHEN 1 THEN round(o_totalprice, 2) WHEN 2 THEN ('.' || floor(o_totalprice)::BIGINT)::DOUBLE WHEN 5 THEN -round(o_totalprice, 1) END price FROM orders",
}

