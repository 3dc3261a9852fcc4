"""Review questions: seams, doubts about prices, accuracy, codes and probes; with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..operators import codes, probes
from ..operators import similarity as S
from ..operators.medians import medians
from ..operators.runs import seams, weak
from .oracle import _FAM, _PRICE, ORACLE as _BASE
from ..stage import settle
from .queries import eval_pairwise, families, price_block, priced_in_basis, read

#: The probe of ``simulate_probe``, before it is normalised.
PROBE = "red bolt, economy"


def plan_split(spark, d):
    """Where each family would be split, the size of both sides, and whether the seam is weak."""
    return seams(families(spark, d)[0]).select("family_no", (F.col("p") / 10000).alias("lower"), (F.col("q") / 10000).alias("upper"), "below", (F.col("members") - F.col("below")).alias("keep"), weak(F.col("p"), F.col("q")).alias("weak"))


def unit_medians_of(records):
    """Owners with five priced rows or more in the basis unit: n, median, the family's mid, and raw_ratio between them."""
    inside = priced_in_basis(records)
    whole = medians(inside, ["family_no"], "price", "mid")
    sizes = inside.groupBy("family_no", "cpse").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= C.MIN_ROWS_FOR_UNIT_OUTLIER)
    per = sizes.join(medians(inside, ["family_no", "cpse"], "price", "median"), ["family_no", "cpse"])
    return per.join(whole, "family_no").withColumn("raw_ratio", F.col("median") / F.col("mid"))


def unit_medians(spark, d):
    """Owners' medians against the family's."""
    per = unit_medians_of(families(spark, d)[0])
    return per.select("family_no", "cpse", "n", F.round("median", 4).alias("median"), F.round("raw_ratio", 4).alias("ratio"), (F.col("raw_ratio") > C.UNIT_OUTLIER_RATIO).alias("outlier"))


def spread_suspicion(spark, d):
    """none, watch or high: a spread of twenty or more, and a score below the accepted band."""
    records, clusters = families(spark, d)
    doubts = (F.col("price_spread") >= C.SUSPECT_SPREAD_RATIO).cast("int") + (F.col("mean") < C.ACCEPT_FLOOR).cast("int")
    level = F.element_at(F.array(F.lit("none"), F.lit("watch"), F.lit("high")), F.coalesce(doubts, (F.col("mean") < C.ACCEPT_FLOOR).cast("int")) + 1)
    return clusters.join(price_block(records), "family_no").select("family_no", "price_spread", level.alias("suspicion"))


def eval_scores(spark, d):
    """F1, Rand and adjusted Rand of the families against part types; null where undefined."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    total, chance = tp + fp + fn + tn, (tp + fp) * (tp + fn)
    over = lambda a, b: F.round(F.try_divide(a, b), 4)
    return eval_pairwise(spark, d).select(over(2 * tp, 2 * tp + fp + fn).alias("f1"), over(tp + tn, total).alias("rand"), over(tp - chance / total, (2 * tp + fp + fn) / 2 - chance / total).alias("adjusted_rand"))


def eval_examples(spark, d):
    """The six largest families that hold more than one label."""
    records, _ = families(spark, d)
    mixed = records.groupBy("family_no").agg(F.countDistinct("label").alias("n_labels"), F.count(F.lit(1)).alias("n_records")).filter("n_labels > 1")
    return mixed.orderBy(F.desc("n_records"), "family_no").limit(6)


def proposed_codes(spark, d):
    return codes.propose(families(spark, d)[1])


def proposed_codes_with_items(spark, d):
    """Codes where every second family's item is named: by its first label, as a model would."""
    records, clusters = families(spark, d)
    items = records.filter("family_no % 2 = 0").groupBy("family_no").agg(F.concat(F.lit(" "), F.min("label"), F.lit(" item")).alias("item"))
    return codes.propose(clusters, items)


def code_summary(spark, d):
    return proposed_codes(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n_families"))


def simulate_probe(spark, d):
    """The six families nearest to a new description, and whether it would join each."""
    _, clusters = families(spark, d)
    grams = settle(S.trigrams(clusters.select(F.col("family_no").alias("id"), F.col("golden").alias("text"))), "family-grams")
    probe = S.trigrams(spark.range(1).select("id", T.normalize(F.lit(PROBE)).alias("text")))
    top = probes.nearest(probe, grams, 6)
    return top.select(F.col("other").alias("family_no"), F.round("cos", 4).alias("score"), (F.col("cos") >= C.SIMILARITY_THRESHOLD).alias("merges"))


def probe_top3(spark, d):
    """The three families nearest to each way of naming a part by type, name and maker."""
    _, clusters = families(spark, d)
    grams = settle(S.trigrams(clusters.select(F.col("family_no").alias("id"), F.col("golden").alias("text"))), "family-grams")
    described = F.concat_ws(" ", "p_type", "p_name", "p_brand")
    texts = read(spark, d, "part").groupBy(T.normalize(described).alias("text")).agg(F.min("p_partkey").cast("long").alias("id"))
    top = probes.nearest(settle(S.trigrams(texts), "probe-grams"), grams, 3)
    return top.select(F.col("id").alias("part"), F.col("place").cast("long").alias("place"), F.col("other").alias("family_no"), F.round("cos", 4).alias("score"))


def audit_export(spark, d):
    """The records with their proposed code and the review state of a run that nobody has reviewed."""
    records, clusters = families(spark, d)
    coded = records.join(codes.propose(clusters).select("family_no", "proposed_code"), "family_no", "left")
    return coded.select("row_id", "description", "cpse", "family_no", "score", F.coalesce("proposed_code", F.lit("")).alias("proposed_code"), F.lit("unreviewed").alias("review_state"))


QUERIES = {f.__name__: f for f in (plan_split, unit_medians, spread_suspicion, eval_scores, eval_examples, proposed_codes, proposed_codes_with_items, code_summary, simulate_probe, probe_top3, audit_export)}

_WORDS = ", ".join(f"'{w}'" for w in (*C.CODE_STOPWORDS, *C.CODE_MODIFIERS))
_CODES = f"""{_FAM}, tk AS (SELECT family_no, golden, list_filter(string_split_regex(upper(golden), '[^A-Z0-9]+'), lambda w: length(w) >= 2 AND w NOT IN ({_WORDS}) AND NOT regexp_matches(w, '^[0-9]|[0-9]{{2,}}|^M[0-9]|X[0-9]')) ws FROM c),
tw AS (SELECT family_no, unnest(ws) word, unnest(range(1, len(ws) + 1)) pos FROM tk), fq AS (SELECT word, count(DISTINCT family_no) nf FROM tw GROUP BY word),
pk AS (SELECT family_no, arg_min(tw.word, (nf < 2, pos)) word FROM tw JOIN fq ON tw.word = fq.word GROUP BY family_no),
ct AS (SELECT family_no, golden, CASE WHEN word IS NULL THEN 'GEN' WHEN length(word) <= 5 OR length(word[1] || regexp_replace(word[2:], '[AEIOU]', '', 'g')) < 2 THEN left(word, 5)
  ELSE left(word[1] || regexp_replace(word[2:], '[AEIOU]', '', 'g'), 5) END category FROM tk LEFT JOIN pk USING (family_no)),
cd AS (SELECT family_no, category, 'MTL-' || category || '-' || CASE WHEN k < 10000 THEN lpad(k::VARCHAR, 4, '0') ELSE k::VARCHAR END proposed_code FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY upper(golden), family_no) k FROM ct))"""

ORACLE = {
    "plan_split": f"""WITH {_FAM}, pt AS (SELECT family_no, round(score * 10000)::INT p, count(*) n FROM r GROUP BY 1, 2),
      cu AS (SELECT family_no, p, lead(p) OVER t q, sum(n) OVER t below, sum(n) OVER (PARTITION BY family_no) members FROM pt WINDOW t AS (PARTITION BY family_no ORDER BY p)),
      b AS (SELECT family_no, arg_max(p, (q - p, -p)) p, arg_max(q, (q - p, -p)) q, arg_max(below, (q - p, -p)) below, any_value(members) members FROM cu WHERE q IS NOT NULL GROUP BY family_no)
      SELECT family_no, p / 10000.0::DOUBLE lower, q / 10000.0::DOUBLE upper, below::BIGINT below, (members - below)::BIGINT keep, q - p < 1000 AND p >= 8200 weak FROM b""",
    "unit_medians": f"""{_PRICE}, wh AS (SELECT family_no, median(price) mid FROM ins GROUP BY 1), pu AS (SELECT family_no, cpse, count(*) n, median(price) med FROM ins GROUP BY 1, 2 HAVING count(*) >= 5)
      SELECT family_no, cpse, n, round(med, 4) median, round(med / mid, 4) ratio, med / mid > 1.25 outlier FROM pu JOIN wh USING (family_no)""",
    "spread_suspicion": f"{_PRICE} SELECT family_no, price_spread, ['none', 'watch', 'high'][(price_spread >= 20)::INT + (mean < 0.82)::INT + 1] suspicion FROM ps JOIN c USING (family_no)",
    "eval_scores": f"""WITH e0 AS ({_BASE["eval_pairwise"]}), e1 AS (SELECT tp::DOUBLE tp, fp::DOUBLE fp, fn::DOUBLE fn, tn::DOUBLE tn, (tp + fp + fn + tn)::DOUBLE total, (tp + fp)::DOUBLE * (tp + fn)::DOUBLE chance FROM e0)
      SELECT round(2 * tp / nullif(2 * tp + fp + fn, 0), 4) f1, round((tp + tn) / nullif(total, 0), 4) rand, round((tp - chance / total) / nullif((2 * tp + fp + fn) / 2 - chance / total, 0), 4) adjusted_rand FROM e1""",
    "eval_examples": f"WITH {_FAM} SELECT family_no, count(DISTINCT label) n_labels, count(*) n_records FROM r GROUP BY 1 HAVING count(DISTINCT label) > 1 ORDER BY n_records DESC, family_no LIMIT 6",
    "proposed_codes": f"WITH {_CODES} SELECT family_no, category, proposed_code FROM cd",
    "proposed_codes_with_items": "WITH " + _CODES.replace("FROM tk LEFT JOIN pk USING (family_no)", "FROM tk LEFT JOIN (SELECT family_no, coalesce(own, word) word FROM (SELECT family_no FROM c) LEFT JOIN pk USING (family_no) LEFT JOIN (SELECT family_no, upper(string_split(min(label), ' ')[1]) own FROM r WHERE family_no % 2 = 0 GROUP BY 1) USING (family_no)) USING (family_no)") + " SELECT family_no, category, proposed_code FROM cd",
    "code_summary": f"WITH {_CODES} SELECT category, count(*) n_families FROM cd GROUP BY 1",
    "simulate_probe": f"""WITH {_FAM}, pb AS (SELECT gram, count(*) np FROM (SELECT unnest(list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3))) gram FROM (SELECT ' RED BOLT ECONOMY ' x)) GROUP BY gram),
      gg AS (SELECT family_no, q.gram, q.n, q.q FROM gd JOIN q ON q.id = gd.gid), dd AS (SELECT family_no, sum(n * np) / sqrt((any_value(gg.q) * (SELECT sum(np * np) FROM pb))::DOUBLE) cos FROM gg JOIN pb USING (gram) GROUP BY family_no)
      SELECT family_no, round(cos, 4) score, cos >= 0.75 merges FROM dd ORDER BY cos DESC, family_no LIMIT 6""",
    "probe_top3": f"""WITH {_FAM}, pt AS (SELECT upper(p_type || ' ' || p_name || ' ' || p_brand) x, min(p_partkey)::BIGINT part FROM part GROUP BY 1),
      pg AS (SELECT part, gram, count(*) np FROM (SELECT part, unnest(list_transform(range(1, length(x) + 1), lambda i: substr(' ' || x || ' ', i, 3))) gram FROM pt) GROUP BY part, gram),
      pq AS (SELECT part, gram, np, sum(np * np) OVER (PARTITION BY part) qp FROM pg), gg AS (SELECT family_no, q.gram, q.n, q.q FROM gd JOIN q ON q.id = gd.gid),
      dd AS (SELECT part, family_no, sum(n * np) / sqrt((any_value(gg.q) * any_value(qp))::DOUBLE) cos FROM gg JOIN pq USING (gram) GROUP BY part, family_no)
      SELECT part, place, family_no, round(cos, 4) score FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY cos DESC, family_no) place FROM dd) WHERE place <= 3""",
    "audit_export": f"WITH {_CODES} SELECT row_id, description, cpse, r.family_no, score, coalesce(proposed_code, '') proposed_code, 'unreviewed' review_state FROM r LEFT JOIN cd ON r.family_no = cd.family_no",
}
