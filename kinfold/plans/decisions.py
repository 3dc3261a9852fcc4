"""Decisions taken on a run of the materials, drawings of it, and its inference; with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import dense, enrich, graph, runs
from ..operators import similarity as S
from ..sources import roles, sinks
from ..stage import new_path
from ..streaming import assign
from .oracle import _E, _FAM, _M, _STATUS
from .queries import DENSE, families, materials, read, vectors

CAP = 8


def fresh_run(spark: SparkSession, d: str) -> runs.Run:
    return runs.Run.save(families(spark, d)[0], new_path(spark, "runs"))


def first_with_seam(run: runs.Run) -> int:
    return runs.seams(run.records()).agg(F.min("family_no")).first()[0]


def standing(run: runs.Run) -> DataFrame:
    return run.families().select("family_no", "golden", "members", "units", F.round("mean", 4).alias("mean_similarity"), F.col("lowest").alias("min_similarity"), "status", "approved", "split_from")


def split_applied(spark, d):
    """All families after the first that has a seam was split there."""
    run = fresh_run(spark, d)
    run.split(first_with_seam(run), force=True)
    return standing(run)


def merge_applied(spark, d):
    """All families after the first two were merged."""
    run = fresh_run(spark, d)
    run.approve(1)
    run.merge(1, 2)
    return standing(run)


def undo_restores(spark, d):
    """All families after a split, a merge and two undone decisions: as at first."""
    run = fresh_run(spark, d)
    run.split(first_with_seam(run), force=True)
    run.merge(2, 3)
    run.undo(force=True)
    run.undo(force=True)
    return standing(run)


def reviewed_run(spark: SparkSession, d: str) -> runs.Run:
    run = fresh_run(spark, d)
    run.approve(3, by="Ann")
    run.split(first_with_seam(run), force=True, by="Bo, \"B\"")
    run.merge(3, 2, by="Ann")
    run.undo(by="Cy", force=True)
    return run


def decision_log(spark, d):
    """An approval, a split and an undone merge, as logged; times and texts left out."""
    log = reviewed_run(spark, d).log()
    return log.select("seq", "by", "verb", "family_no", "related_no", "affected", "reversible", "undone", F.coalesce("undone_by", F.lit("")).alias("undone_by"))


def decision_summary(spark, d):
    """Counts of decisions; times and texts left out."""
    return reviewed_run(spark, d).summary().drop("first_at", "last_at", "undoable_summary")


def review_states(spark, d):
    return reviewed_run(spark, d).review_states().select("family_no", "state", "by", "merged_from", "split_from")


def pending(spark, d):
    """Families that wait for a person, with the first of them approved."""
    run = fresh_run(spark, d)
    first = run.pending().agg(F.min("family_no")).first()[0]
    if first is not None:
        run.approve(first)
    return run.pending().select("family_no", "members", "status")


def graph_masters(spark, d):
    _, clusters = families(spark, d)
    return graph.masters(clusters).select("family_no", "golden", "members", "units", F.round("mean", 4).alias("mean_similarity"))


def graph_legacy(spark, d):
    """Up to eight records of each drawn family, in turns over its spellings."""
    records, clusters = families(spark, d)
    drawn = records.join(graph.masters(clusters).select("family_no"), "family_no", "left_semi")
    return graph.sampled(drawn, CAP).select("family_no", "place", "spelling", "n", "score", "cpse")


def communities_mis(spark, d):
    return S.numbered(dense.communities_mis(vectors(spark, d), DENSE)).select("family_no", "seed", "size")


def infer_roles(spark, d):
    """The role each column of part was taken for."""
    chosen = roles.infer(roles.profiles(read(spark, d, "part")))
    return spark.createDataFrame([(role, c.column, c.how) for role, c in chosen.items()], "role string, chosen string, how string")


def infer_roles_renamed(spark, d):
    """Roles of the materials' columns under an ERP's names, of which the engine knows none by heart, and of a column of known groups."""
    m = materials(spark, d)
    named = m.select(F.col("description").alias("MAKTX"), F.col("cpse").alias("WERKS"), F.col("row_id").alias("LFDNR"), F.col("code").alias("MATNR"), F.col("price").alias("NETPR"), F.col("uom").alias("MEINS"), F.col("label").alias("gold_group"))
    chosen = roles.infer(roles.profiles(named))
    return spark.createDataFrame([(role, c.column, c.how) for role, c in chosen.items()], "role string, chosen string, how string")


def column_profiles(spark, d):
    """What the columns of part hold, as the inference of roles sees them."""
    rows = [(c, p.n, *(round(x, 4) for x in (p.mean_len, p.distinct, p.numeric, p.spaces, p.uom, p.positive, p.fractional))) for c, p in roles.profiles(read(spark, d, "part")).items()]
    return spark.createDataFrame(rows, "column_name string, n long, mean_len double, distinct_share double, numeric double, spaces double, uom double, positive double, fractional double")


def assign_new(spark, d):
    """The nearest family of every distinct material type, as a batch of the stream would get it."""
    _, clusters = families(spark, d)
    rows = materials(spark, d).groupBy("label").agg(F.min("row_id").alias("row_id")).select("row_id", F.col("label").alias("description"))
    return assign.assign(rows, clusters)


def unit_rail(spark, d):
    """The forty owners with most records: families and records of each."""
    records, _ = families(spark, d)
    return records.groupBy("cpse").agg(F.countDistinct("family_no").alias("n_families"), F.count(F.lit(1)).alias("n_records")).orderBy(F.desc("n_records"), "cpse").limit(40)


def family_detail(spark, d):
    """The members of the first family, and which of them read as its golden text."""
    records, _ = families(spark, d)
    return records.filter("family_no = 1").select("row_id", "description", "cpse", "score", (F.col("text") == F.col("golden")).alias("is_golden")).orderBy(F.desc("score"), "row_id").limit(200)


def export_mapping(spark, d):
    """The published mapping of a fresh run."""
    return sinks.mapping(fresh_run(spark, d)).drop("family_no")


def export_audited(spark, d):
    """The mapping after an approval, a split and an undone merge; times left out."""
    return sinks.audited(reviewed_run(spark, d)).select("row_id", "Family_ID", "Golden_Record", "Review_State", "Reviewed_By", "Merged_From", "Split_From")


def merge_candidates(spark, d):
    """The sixty largest families written in more than one way, and their first eight ways."""
    records, _ = families(spark, d)
    return enrich.merge_candidates(records).select("family_no", "golden", "members", F.array_join("ways", "|").alias("ways"))


QUERIES = {f.__name__: f for f in (split_applied, merge_applied, undo_restores, decision_log, decision_summary, review_states, pending, graph_masters, graph_legacy, communities_mis, infer_roles, infer_roles_renamed, column_profiles, assign_new, unit_rail, family_detail, export_mapping, export_audited, merge_candidates)}

_SEAM = f"""{_FAM}, pt AS (SELECT family_no, round(score * 10000)::INT p, count(*) n FROM r GROUP BY 1, 2),
cu AS (SELECT family_no, p, lead(p) OVER w q, sum(n) OVER w below FROM pt WINDOW w AS (PARTITION BY family_no ORDER BY p)),
fs AS (SELECT family_no fno, arg_max(p, (q - p, -p)) cut, arg_max(below, (q - p, -p))::BIGINT below FROM cu WHERE q IS NOT NULL GROUP BY family_no ORDER BY family_no LIMIT 1)"""
_SCORE = "round(least(coalesce(dot / sqrt((qa * qb)::DOUBLE), 0), 1), 4)"
_CAP = "CASE WHEN {t} AND avg(score) >= 0.82 THEN 'review' WHEN avg(score) >= 0.95 THEN 'resolved' WHEN avg(score) >= 0.82 THEN 'accepted' WHEN avg(score) >= 0.75 THEN 'review' ELSE 'conflict' END"
_STANDING = "SELECT family_no, golden, count(*) members, count(DISTINCT cpse) units, round(avg(score), 4) mean_similarity, min(score) min_similarity, {status} status, {approved} approved, {origin} split_from FROM {of} GROUP BY family_no, golden"
_LOG = f"""{_SEAM}, sz AS (SELECT family_no, members FROM c), mm AS (SELECT (SELECT members FROM sz WHERE family_no = 3) - CASE WHEN (SELECT fno FROM fs) = 3 THEN (SELECT below FROM fs) ELSE 0 END m3,
  (SELECT members FROM sz WHERE family_no = 2) - CASE WHEN (SELECT fno FROM fs) = 2 THEN (SELECT below FROM fs) ELSE 0 END m2),
lg AS (SELECT 1::BIGINT seq, 'Ann' AS "by", 'approve' verb, 3::BIGINT family_no, NULL::BIGINT related_no, (SELECT members FROM sz WHERE family_no = 3) affected, false undone, '' undone_by
  UNION ALL SELECT 2, 'Bo B', 'split', (SELECT fno FROM fs), (SELECT max(family_no) + 1 FROM f), (SELECT below FROM fs), false, ''
  UNION ALL SELECT 3, 'Ann', 'merge', CASE WHEN m2 > m3 THEN 2 ELSE 3 END, CASE WHEN m2 > m3 THEN 3 ELSE 2 END, least(m2, m3), true, 'Cy' FROM mm)"""
_CELLS = ", ".join(f"'{u}'" for u in C.UOM_CELLS)
_PROFILE = f"""SELECT '{{c}}' column_name, count(t) n, round(avg(length(t)), 4) mean_len, round(count(DISTINCT t) / count(t), 4) distinct_share, round(count(x) / count(t), 4) numeric, round(count(*) FILTER (contains(t, ' ')) / count(t), 4) spaces, round(count(*) FILTER (upper(t) IN ({_CELLS})) / count(t), 4) uom,
  round(coalesce(count(*) FILTER (x > 0) / nullif(count(x), 0), 0), 4) positive, round(coalesce(count(*) FILTER (x % 1 <> 0) / nullif(count(x), 0), 0), 4) fractional FROM (SELECT t, try_cast(replace(t, ',', '') AS DOUBLE) x FROM (SELECT nullif(trim({{c}}::VARCHAR), '') t FROM part))"""


def _values(rows) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ")"


def _roles_sql(source: str, columns: tuple[str, ...], first: str = "") -> str:
    """The roles of the columns of a query, step by step as people would ask it of their profiles."""
    share = lambda test, of: f"coalesce(count(*) FILTER ({test}) / nullif(count({of}), 0), 0)"
    one = f"""SELECT {{i}} i, '{{c}}' col, count(*) every, count(t) n, coalesce(avg(length(t)), 0) ml, coalesce(count(DISTINCT t) / nullif(count(t), 0), 0) ds, {share("x IS NOT NULL", "t")} nu, {share("contains(t, ' ')", "t")} sp,
      {share(f"upper(t) IN ({_CELLS})", "t")} um, {share("x > 0", "x")} po, {share("x % 1 <> 0", "x")} fr FROM (SELECT t, try_cast(replace(t, ',', '') AS DOUBLE) x FROM (SELECT nullif(trim("{{c}}"::VARCHAR), '') t FROM src))"""
    tokens = _values([(role, word, float(w)) for role, words in C.ROLE_TOKENS.items() for word, w in words.items()])
    names = _values([(role, k, name) for role, known in C.ROLE_NAMES.items() for k, name in enumerate(known)])
    content = """CASE role WHEN 'description' THEN prose - 5 * nu - 6 * um WHEN 'unit' THEN CASE WHEN ds < 0.05 THEN 2.5 WHEN ds < 0.2 THEN 1.2 ELSE -1.5 END + CASE WHEN ml <= 24 THEN 1 ELSE -1 END - 2.5 * nu
      WHEN 'code' THEN 3 * ds + CASE WHEN ml <= 24 THEN 1.2 ELSE -1.5 END - 1.5 * sp WHEN 'price' THEN 3 * nu + 2 * po + 1.5 * fr + CASE WHEN ds > 0.3 THEN 0.8 ELSE 0 END WHEN 'measure' THEN 6 * um END"""
    allowed = """CASE role WHEN 'description' THEN ct >= 1.2 WHEN 'unit' THEN ct > 0 AND um <= 0.35 WHEN 'code' THEN ds >= 0.4 WHEN 'price' THEN nu >= 0.8 AND po >= 0.8 WHEN 'measure' THEN um >= 0.45 AND ml <= 12 AND ds <= 0.25 END"""
    best = lambda role, taken: f"(SELECT col FROM sc WHERE role = '{role}' AND col NOT IN (SELECT col FROM ({taken}) WHERE col IS NOT NULL) ORDER BY s DESC, i LIMIT 1)"
    known = lambda role, more="true": f"(SELECT col FROM nk WHERE role = '{role}' AND {more} LIMIT 1)"
    none = "SELECT NULL::VARCHAR col"
    step = lambda name, role, taken, known_: f"{name} AS (SELECT '{role}' AS role, coalesce({known_}, {best(role, taken)}) col, CASE WHEN {known_} IS NOT NULL THEN 'a known name' ELSE 'its name and what it holds' END how)"
    upto = lambda *steps: " UNION ALL ".join(f"SELECT col FROM {x}" for x in steps)
    return f"""WITH {first}src AS ({source}), pf AS ({" UNION ALL ".join(one.format(i=i, c=c) for i, c in enumerate(columns))}),
      pr AS (SELECT *, 2.2 * least(ml / 18, 2) + 2.4 * ds + 2 * sp prose, regexp_replace(lower(trim(col)), '[_-]+', ' ', 'g') spaced, trim(regexp_replace(lower(trim(col)), '[^a-z0-9 ]+', ' ', 'g')) plain FROM pf),
      tk AS (SELECT * FROM {tokens} v(role, word, w)), nm AS (SELECT * FROM {names} v(role, k, name)), ls AS (SELECT * FROM (VALUES ('description', 1.0), ('unit', 2.0), ('code', 1.5), ('price', 2.0), ('measure', 0.0)) v(role, least_name)),
      wt AS (SELECT pr.*, ls.role, least_name, coalesce((SELECT max(w) FROM tk WHERE tk.role = ls.role AND (contains(spaced, word) OR contains(replace(spaced, ' ', ''), replace(word, ' ', '')))), 0) w FROM pr CROSS JOIN ls),
      cn AS (SELECT *, {content} ct FROM wt), sc AS (SELECT role, i, col, w + ct s FROM cn WHERE n > 0 AND w >= least_name AND {allowed} AND w + ct > 0),
      nk AS (SELECT nm.role, pr.col, pr.um, row_number() OVER (PARTITION BY nm.role ORDER BY nm.k, pr.i DESC) r FROM nm JOIN pr ON lower(nm.name) = lower(trim(pr.col)) QUALIFY r = 1),
      tx AS (SELECT col, prose, lead(prose) OVER (ORDER BY prose DESC, col DESC) nx, row_number() OVER (ORDER BY prose DESC, col DESC) r FROM pr WHERE n > 0 AND ml >= 8 AND nu <= 0.2 AND um <= 0.2 AND sp >= 0.2 AND ds >= 0.005),
      {step("d0", "description", none, known("description"))},
      d AS (SELECT role, coalesce(col, (SELECT col FROM tx WHERE r = 1 AND (nx IS NULL OR prose > 1.5 * nx))) col, CASE WHEN col IS NULL THEN 'the only column of free text' ELSE how END how FROM d0),
      {step("u", "unit", upto("d"), known("unit", "um <= 0.5"))}, {step("c0", "code", upto("d", "u"), known("code"))}, {step("q0", "price", upto("d", "u", "c0"), "NULL::VARCHAR")}, {step("m0", "measure", upto("d", "u", "c0", "q0"), "NULL::VARCHAR")},
      lw AS (SELECT *, coalesce((SELECT max(w) FROM tk WHERE role = 'label' AND contains(plain, word)), 0) w, n / greatest(every, 1) cover FROM pr),
      lb AS (SELECT 'label' AS role, col, 'about ' || round(ds * n)::BIGINT || ' groups over ' || n || ' rows' how FROM lw WHERE w > 0 AND cover >= 0.6 AND round(ds * n) >= 2 AND ds <= 0.92 AND col NOT IN (SELECT col FROM ({upto("d", "u", "c0", "q0", "m0")}) WHERE col IS NOT NULL)
        ORDER BY w + 2 * (1 - abs(0.35 - ds)) + cover DESC, i LIMIT 1)
      SELECT role, col chosen, how FROM ({" UNION ALL ".join(f"SELECT role, col, how FROM {x}" for x in ("d", "u", "c0", "q0", "m0", "lb"))}) WHERE col IS NOT NULL"""


ORACLE = {
    "infer_roles": _roles_sql("SELECT * FROM part", ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")),
    "infer_roles_renamed": _roles_sql('SELECT description "MAKTX", cpse "WERKS", row_id "LFDNR", code "MATNR", price "NETPR", uom "MEINS", label "gold_group" FROM m', ("MAKTX", "WERKS", "LFDNR", "MATNR", "NETPR", "MEINS", "gold_group"), _M[: _M.index('t AS (')]),
    "split_applied": f"""WITH {_SEAM}, lv AS (SELECT r.*, t.id tid FROM r JOIN t USING (text) JOIN fs ON r.family_no = fs.fno WHERE round(score * 10000) <= cut),
      gn AS (SELECT arg_max(text, (length(text), score, -row_id)) golden, arg_max(tid, (length(text), score, -row_id)) gid FROM lv),
      nw AS (SELECT lv.row_id, (SELECT max(family_no) + 1 FROM f) nf, gn.golden ng, {_SCORE} ns FROM lv CROSS JOIN gn LEFT JOIN dots ON dots.i = lv.tid AND dots.j = gn.gid),
      cur AS (SELECT r.cpse, coalesce(nf, family_no) family_no, coalesce(ng, golden) golden, coalesce(ns, score) score FROM r LEFT JOIN nw USING (row_id))
      {_STANDING.format(status=_CAP.format(t="family_no IN ((SELECT fno FROM fs), (SELECT max(family_no) + 1 FROM f))"), approved="false", origin="CASE WHEN family_no = (SELECT max(family_no) + 1 FROM f) THEN (SELECT fno FROM fs) END", of="cur")}""",
    "merge_applied": f"""WITH {_FAM}, k AS (SELECT CASE WHEN (SELECT members FROM c WHERE family_no = 2) > (SELECT members FROM c WHERE family_no = 1) THEN 2 ELSE 1 END k),
      bo AS (SELECT r.*, t.id tid FROM r JOIN t USING (text) WHERE family_no IN (1, 2)), gn AS (SELECT arg_max(text, (length(text), family_no = k, score, -row_id)) golden, arg_max(tid, (length(text), family_no = k, score, -row_id)) gid FROM bo CROSS JOIN k),
      nw AS (SELECT bo.row_id, k nf, gn.golden ng, {_SCORE} ns FROM bo CROSS JOIN k CROSS JOIN gn LEFT JOIN dots ON dots.i = bo.tid AND dots.j = gn.gid),
      cur AS (SELECT r.cpse, coalesce(nf, family_no) family_no, coalesce(ng, golden) golden, coalesce(ns, score) score FROM r LEFT JOIN nw USING (row_id))
      {_STANDING.format(status=_CAP.format(t="family_no = (SELECT k FROM k)"), approved="false", origin="NULL::BIGINT", of="cur")}""",
    "undo_restores": f"WITH {_FAM} {_STANDING.format(status=_CAP.format(t='false'), approved='false', origin='NULL::BIGINT', of='r')}",
    "decision_log": f'WITH {_LOG} SELECT seq, "by", verb, family_no, related_no, affected, verb = \'approve\' OR affected <= 20000 reversible, undone, undone_by FROM lg',
    "decision_summary": f"WITH {_LOG} SELECT 3::BIGINT logged, 2::BIGINT live, 1::BIGINT undone, 1::BIGINT approve, 1::BIGINT split, 0::BIGINT AS merge, sum(affected)::BIGINT records_touched, CASE WHEN arg_max(affected, seq) <= 20000 THEN max(seq) END undoable_seq FROM lg WHERE NOT undone",
    "review_states": f"""WITH {_LOG}, nm AS (SELECT seq, family_no, verb, "by", NULL::BIGINT origin FROM lg WHERE NOT undone UNION ALL SELECT seq, related_no, verb, "by", family_no FROM lg WHERE NOT undone AND verb = 'split')
      SELECT family_no, arg_max(CASE verb WHEN 'approve' THEN 'confirmed' ELSE 'split' END, seq) state, arg_max("by", seq) AS "by", NULL::BIGINT merged_from, max(origin) split_from FROM nm GROUP BY family_no""",
    "pending": f"WITH {_FAM}, pd AS (SELECT family_no, members, {_STATUS} AS status FROM c) SELECT family_no, members, status FROM pd WHERE status IN ('review', 'conflict') AND family_no <> (SELECT min(family_no) FROM pd WHERE status IN ('review', 'conflict'))",
    "graph_masters": f"WITH {_FAM} SELECT family_no, golden, members, units, round(mean, 4) mean_similarity FROM c ORDER BY members DESC, family_no LIMIT {C.GRAPH_FAMILIES}",
    "graph_legacy": f"""WITH {_FAM}, ms AS (SELECT family_no FROM c ORDER BY members DESC, family_no LIMIT {C.GRAPH_FAMILIES}), sp AS (SELECT family_no, upper(description) spelling, count(*) n, arg_min(score, row_id) score, arg_min(cpse, row_id) cpse, min(row_id) fr FROM r WHERE family_no IN (SELECT family_no FROM ms) GROUP BY 1, 2),
      rk AS (SELECT *, row_number() OVER (PARTITION BY family_no ORDER BY n, score DESC, fr) s FROM sp), tn AS (SELECT *, unnest(range(1, least(n, {CAP}) + 1)) turn FROM rk),
      pl AS (SELECT *, (row_number() OVER (PARTITION BY family_no ORDER BY turn, s))::INT place FROM tn) SELECT family_no, place, spelling, n, score, cpse FROM pl WHERE place <= {CAP}""",
    "communities_mis": f"""WITH RECURSIVE {_E.format(t=0.3)}, g AS (SELECT i, count(*) deg, list(j) near FROM e GROUP BY i), o AS (SELECT *, row_number() OVER (ORDER BY deg DESC, i) rk FROM g),
      mi(k, seeds) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT k + 1, CASE WHEN list_has_any(seeds, near) THEN seeds ELSE list_append(seeds, i) END FROM mi JOIN o ON rk = k + 1),
      sd AS (SELECT unnest(seeds) i FROM (SELECT seeds FROM mi ORDER BY k DESC LIMIT 1)), s AS (SELECT e.j p, arg_min(e.i, (-g.deg, e.i)) seed FROM e JOIN sd ON e.i = sd.i JOIN g ON g.i = e.i GROUP BY e.j),
      zz AS (SELECT seed, deg, count(*) size FROM s JOIN g ON g.i = s.seed GROUP BY 1, 2) SELECT row_number() OVER (ORDER BY size DESC, deg DESC, seed) family_no, seed, size FROM zz""",
    "column_profiles": " UNION ALL ".join(_PROFILE.format(c=c) for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")),
    "assign_new": f"""WITH {_FAM}, nw AS (SELECT min(row_id) row_id, upper(label) AS text FROM m GROUP BY label), n0 AS (SELECT text tx, gram, count(*) n FROM (SELECT text, unnest(list_transform(range(1, length(text) + 1), lambda i: substr(' ' || text || ' ', i, 3))) gram FROM nw) GROUP BY 1, 2),
      n1 AS (SELECT *, sum(n * n) OVER (PARTITION BY tx) qn FROM n0), fg AS (SELECT family_no, q.gram, q.n nf, q.q qf FROM gd JOIN q ON q.id = gd.gid),
      dd AS (SELECT tx, family_no, sum(n * nf) / sqrt((any_value(qn) * any_value(qf))::DOUBLE) cos FROM n1 JOIN fg USING (gram) GROUP BY 1, 2), bb AS (SELECT tx, arg_max(family_no, (cos, -family_no)) family_no, max(cos) cos FROM dd GROUP BY tx)
      SELECT row_id, text, family_no, round(cos, 4) score, coalesce(cos >= 0.75, false) merges FROM nw LEFT JOIN bb ON tx = text""",
    "unit_rail": f"WITH {_FAM} SELECT cpse, count(DISTINCT family_no) n_families, count(*) n_records FROM r GROUP BY cpse ORDER BY n_records DESC, cpse LIMIT 40",
    "family_detail": f"WITH {_FAM} SELECT row_id, description, cpse, score, text = golden is_golden FROM r WHERE family_no = 1 ORDER BY score DESC, row_id LIMIT 200",
    "export_mapping": f"""WITH {_FAM} SELECT row_id, 'FAM_' || lpad(family_no::VARCHAR, 5, '0') "Family_ID", 'MTL-' || lpad(family_no::VARCHAR, 7, '0') "Canonical_Code", description "Original_Description", text "Normalized_Description", golden "Golden_Record",
      score "Semantic_Similarity", CASE WHEN score >= 0.9 THEN 'HIGH' WHEN score >= 0.75 THEN 'MEDIUM' ELSE 'LOW' END "Confidence", cpse "CPSE", code "Original_Material_Code" FROM r""",
    "export_audited": f"""WITH {_SEAM}, lv AS (SELECT r.* FROM r JOIN fs ON r.family_no = fs.fno WHERE round(score * 10000) <= cut), gn AS (SELECT arg_max(text, (length(text), score, -row_id)) ng FROM lv), nn AS (SELECT max(family_no) + 1 nf FROM f),
      cu2 AS (SELECT r.row_id, CASE WHEN lv.row_id IS NULL THEN r.family_no ELSE (SELECT nf FROM nn) END family_no, CASE WHEN lv.row_id IS NULL THEN r.golden ELSE (SELECT ng FROM gn) END golden FROM r LEFT JOIN lv ON lv.row_id = r.row_id)
      SELECT row_id, 'FAM_' || lpad(family_no::VARCHAR, 5, '0') "Family_ID", golden "Golden_Record", CASE WHEN family_no IN ((SELECT fno FROM fs), (SELECT nf FROM nn)) THEN 'split' WHEN family_no = 3 THEN 'confirmed' ELSE 'unreviewed' END "Review_State",
      CASE WHEN family_no IN ((SELECT fno FROM fs), (SELECT nf FROM nn)) THEN 'Bo B' WHEN family_no = 3 THEN 'Ann' ELSE '' END "Reviewed_By", '' "Merged_From", CASE WHEN family_no = (SELECT nf FROM nn) THEN 'FAM_' || lpad((SELECT fno FROM fs)::VARCHAR, 5, '0') ELSE '' END "Split_From" FROM cu2""",
    "merge_candidates": f"""WITH {_FAM}, wy AS (SELECT family_no, golden, description way, count(*) n, min(row_id) fr FROM r GROUP BY 1, 2, 3), ko AS (SELECT *, row_number() OVER (PARTITION BY family_no ORDER BY fr) k FROM wy)
      SELECT family_no, golden, sum(n)::BIGINT members, string_agg(way, '|' ORDER BY k) FILTER (k <= 8) ways FROM ko GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY members DESC, family_no LIMIT 60""",
}
