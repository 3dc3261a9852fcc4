"""DuckDB SQL for the queries of ``plans.queries``."""

_E = "e AS (SELECT a.vec_id i, b.vec_id j, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) cos FROM embeddings a CROSS JOIN embeddings b WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {t})"
_COMM = """g AS (SELECT i, count(*) deg FROM e GROUP BY i),
s AS (SELECT e.j p, arg_min(e.i, (-g.deg, e.i)) seed FROM e JOIN g ON e.i = g.i GROUP BY e.j),
z AS (SELECT s.seed, g.deg, count(*) size FROM s JOIN g ON s.seed = g.i GROUP BY s.seed, g.deg),
f AS (SELECT row_number() OVER (ORDER BY size DESC, deg DESC, seed) family_no, seed, size FROM z)"""
_M = """m AS (SELECT p_partkey row_id, p_name || ' ' || p_type description, upper(p_brand) cpse, CASE WHEN p_partkey % 3 > 0 THEN 'P-' || p_partkey ELSE '' END code, p_retailprice price, p_type AS label,
  ['EACH', 'EACH', 'KG', 'KG', 'M', 'UNSPECIFIED'][p_size % 6 + 1] uom, upper(p_name || ' ' || p_type) AS text FROM part),
t AS (SELECT text, min(row_id) id FROM m GROUP BY text),
g0 AS (SELECT id, gram, count(*) n FROM (SELECT id, unnest(list_transform(range(1, length(text) + 1), lambda i: substr(' ' || text || ' ', i, 3))) gram FROM t) GROUP BY id, gram),
q AS (SELECT id, gram, n, sum(n * n) OVER (PARTITION BY id) q FROM g0),
dots AS (SELECT a.id i, b.id j, sum(a.n * b.n) dot, any_value(a.q) qa, any_value(b.q) qb FROM q a JOIN q b USING (gram) GROUP BY a.id, b.id),
e AS (SELECT i, j FROM dots WHERE 16 * dot * dot >= 9 * qa * qb)"""
_FAM = f"""{_M}, {_COMM},
jn AS (SELECT s.p AS member, f.family_no, t.text FROM s JOIN f ON s.seed = f.seed JOIN t ON t.id = s.p),
gd AS (SELECT family_no, arg_max(member, (length(text), -member)) gid, arg_max(text, (length(text), -member)) golden FROM jn GROUP BY family_no),
sc AS (SELECT jn.text, jn.family_no, gd.golden, round(least(greatest(coalesce(dot / sqrt((qa * qb)::DOUBLE), 0), -1), 1), 4) score
  FROM jn JOIN gd USING (family_no) LEFT JOIN dots ON dots.i = jn.member AND dots.j = gd.gid),
r AS (SELECT m.*, sc.family_no, sc.golden, sc.score FROM m JOIN sc USING (text)),
c AS (SELECT family_no, golden, count(*) members, avg(score) mean, min(score) lowest, count(DISTINCT cpse) units FROM r GROUP BY family_no, golden)"""
_STATUS = "CASE WHEN mean >= 0.95 THEN 'resolved' WHEN mean >= 0.82 THEN 'accepted' WHEN mean >= 0.75 THEN 'review' ELSE 'conflict' END"
_PRICE = f"""WITH {_FAM}, pr AS (SELECT * FROM r WHERE price > 0),
per AS (SELECT family_no, uom, count(*) n, min(row_id) first FROM pr GROUP BY family_no, uom),
ba AS (SELECT family_no, arg_max(uom, (n, -first)) basis_uom, sum(n) all_priced, count(*) uom_forms FROM per GROUP BY family_no),
ins AS (SELECT pr.*, basis_uom, all_priced, uom_forms FROM pr JOIN ba ON pr.family_no = ba.family_no AND pr.uom = ba.basis_uom),
bl AS (SELECT family_no, any_value(basis_uom) basis_uom, any_value(all_priced) all_priced, any_value(uom_forms) uom_forms, count(*) priced, sum(price) spend, min(price) low, max(price) high, median(price) mid FROM ins GROUP BY family_no),
ex AS (SELECT ins.family_no, sum(greatest(price - mid, 0)) excess FROM ins JOIN bl USING (family_no) GROUP BY ins.family_no),
ps AS (SELECT family_no, basis_uom, priced, uom_forms, (all_priced - priced)::BIGINT other_records, round(spend, 2) spend, round(low, 4) price_low, round(high, 4) price_high, round(mid, 4) price_median,
  round(high / low, 2) price_spread, round(spend - low * priced, 2) savings, round(excess, 2) excess FROM bl JOIN ex USING (family_no))"""
_RULES = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\bS\.?S\.?\b', 'STAINLESS STEEL', 'g'), '\bC\.?S\.?\b', 'CARBON STEEL', 'g'), '\bM\.?S\.?\b', 'MILD STEEL', 'g'), '\bDIA\b', 'DIAMETER', 'g'), '\bAPPX\b', 'APPROXIMATE', 'g')"

ORACLE = {
    "clean_unit": "SELECT p_partkey, upper(trim(p_brand)) AS unit FROM part",
    "normalize_text": r"SELECT p_partkey, trim(regexp_replace(regexp_replace(" + _RULES.format(x="upper(p_name || ' s.s. dia, ' || p_type || ';cs/ms')") + r", '[,;:/]+', ' ', 'g'), '\s+', ' ', 'g')) AS normalized FROM part",
    "normalize_trace": """WITH x AS (SELECT p_partkey, lower(p_name) || ' dia, ss' s0 FROM part), y AS (SELECT *, upper(s0) s1 FROM x), z AS (SELECT *, replace(s1, ', SS', ', STAINLESS STEEL') s2, FROM y),
      w AS (SELECT *, replace(s2, ' DIA,', ' DIAMETER,') s3 FROM z)
      SELECT p_partkey, 'base' step, s0 AS before, s1 AS after FROM w UNION ALL SELECT p_partkey, 'STAINLESS STEEL', s1, s2 FROM w UNION ALL SELECT p_partkey, 'DIAMETER', s2, s3 FROM w UNION ALL SELECT p_partkey, 'separators', s3, replace(s3, ',', '') FROM w""",
    "price_parse": "SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders",
    "uom_normalize": "SELECT p_partkey, ['EACH', 'EACH', 'KG', 'KG', 'M', 'UNSPECIFIED'][p_size % 6 + 1] AS canonical, ['count', 'count', 'mass', 'mass', 'length', 'unknown'][p_size % 6 + 1] AS dimension FROM part",
    "uom_summary": "SELECT ['count', 'count', 'mass', 'mass', 'length', 'unknown'][p_size % 6 + 1] AS dimension, count(*) n_rows, count(DISTINCT ['EACH', 'EACH', 'KG', 'KG', 'M', 'UNSPECIFIED'][p_size % 6 + 1]) n_canonical FROM part GROUP BY 1",
    "dedupe_first": "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) k FROM documents) WHERE k = 1",
    "profile_columns": " UNION ALL ".join(f"SELECT '{c}' column_name, count({c}) n, round(avg(length({c})), 4) mean_len, round(count(DISTINCT {c}) / count({c}), 4) distinct_share, round(avg(CASE WHEN contains({c}, ' ') THEN 1.0::DOUBLE ELSE 0 END), 4) space_share FROM part" for c in ("p_name", "p_brand", "p_type")),
    "similarity_edges": f"WITH {_E.format(t=0.3)} SELECT i, j, round(cos, 4) cos FROM e",
    "degrees": f"WITH {_E.format(t=0.3)} SELECT i, count(*) deg FROM e GROUP BY i",
    "communities": f"WITH {_E.format(t=0.3)}, {_COMM} SELECT family_no, seed, size FROM f",
    "communities_trigram": f"WITH {_M}, {_COMM} SELECT family_no, seed, size FROM f",
    "member_similarity": f"WITH {_FAM} SELECT row_id, family_no, golden, score, CASE WHEN score >= 0.9 THEN 'HIGH' WHEN score >= 0.75 THEN 'MEDIUM' ELSE 'LOW' END confidence FROM r",
    "family_status": f"WITH {_FAM} SELECT family_no, golden, members, units, round(mean, 4) mean_similarity, lowest min_similarity, {_STATUS} AS status FROM c",
    "status_distribution": f"WITH {_FAM} SELECT {_STATUS} AS status, count(*) n_families, sum(members)::BIGINT n_records FROM c GROUP BY 1",
    "threshold_bands": f"WITH {_FAM}, k AS (SELECT {_STATUS} AS band, count(*) n_families, sum(members)::BIGINT n_records FROM c GROUP BY 1) SELECT v.band, floor, ceiling, coalesce(n_families, 0) n_families, coalesce(n_records, 0)::BIGINT n_records FROM (VALUES ('resolved', 0.95::DOUBLE, 1.0::DOUBLE), ('accepted', 0.82, 0.95), ('review', 0.75, 0.82), ('conflict', 0.0, 0.75)) v(band, floor, ceiling) LEFT JOIN k ON k.band = v.band",
    "unit_counts": f"WITH {_FAM} SELECT family_no, cpse, count(*) n, row_number() OVER (PARTITION BY family_no ORDER BY count(*) DESC, cpse) place FROM r GROUP BY family_no, cpse",
    "price_stats": f"{_PRICE} SELECT * FROM ps",
    "skewed_price_medians": "SELECT CASE WHEN o_custkey % 10 > 0 THEN 'MOST' ELSE o_orderpriority END kind, round(median(o_totalprice), 4) mid FROM orders GROUP BY 1",
    "savings_totals": f"{_PRICE} SELECT round(sum(spend), 1) spend, round(sum(savings), 1) savings, round(sum(excess), 1) excess, count(*) n_families FROM ps",
    "list_by_unit": f"WITH {_FAM} SELECT family_no, count(*) n_records FROM r WHERE cpse = 'BRAND#1' GROUP BY family_no",
    "search_families": f"WITH {_FAM} SELECT family_no, golden, members FROM c WHERE family_no IN (SELECT family_no FROM r WHERE contains(lower(description), 'on'))",
    "page_families": f"WITH {_FAM} SELECT family_no, members, {_STATUS} AS status FROM c ORDER BY family_no LIMIT 20 OFFSET 10",
    "provenance_spellings": f"WITH {_FAM} SELECT family_no, upper(description) spelling, count(*) n_records, min(score) lowest, count(DISTINCT cpse) n_units FROM r GROUP BY 1, 2",
    "eval_pairwise": f"""WITH {_FAM}, x AS (SELECT (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) n FROM r GROUP BY label, family_no))::BIGINT tp, (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) n FROM r GROUP BY label))::BIGINT truth,
      (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) n FROM r GROUP BY family_no))::BIGINT pred, (SELECT count(*) * (count(*) - 1) // 2 FROM r)::BIGINT total)
      SELECT tp, pred - tp AS fp, truth - tp AS fn, total - truth - pred + tp AS tn, round(tp / pred, 4) prec, round(tp / truth, 4) recall FROM x""",
    "family_purity": f"WITH {_FAM} SELECT family_no, count(DISTINCT label) = 1 AS pure, count(*) members FROM r GROUP BY family_no",
    "threshold_sweep": f"WITH {_FAM}, fl AS (SELECT (x / 100.0)::DECIMAL(4,2) AS fl FROM range(55, 100) v(x)) SELECT fl::DOUBLE AS floor, count(*) FILTER (m >= fl) AS auto, count(*) FILTER (m < fl) AS review, sum(CASE WHEN m < fl THEN members ELSE 0 END)::BIGINT review_records FROM fl, (SELECT round(mean, 4)::DECIMAL(6,4) m, members FROM c) GROUP BY fl",
    "near_miss_pairs": f"WITH {_E.format(t=0.25)} SELECT i, j, round(cos, 4) cos FROM e WHERE i < j AND cos < 0.3 ORDER BY e.cos DESC, i DESC, j DESC LIMIT 36",
}
