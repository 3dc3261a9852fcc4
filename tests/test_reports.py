import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold import constants as C
from kinfold.functions import text as T
from kinfold.operators import dense, enrich, ranking, runs
from kinfold.operators import similarity as S
from kinfold.plans import reports
from kinfold.sources import questions, roles, tables, workbook

PRICED = "row_id long, family_no long, cpse string, uom string, price double"


def test_worst_unit(spark):
    """Five rows at 20 and six at 10: the family's median is 10, X pays twice that; four rows of X say nothing."""
    rows = [(i, 1, "X", "EACH", 20.0) for i in range(5)] + [(i, 1, "Y", "EACH", 10.0) for i in range(5, 11)] + [(i, 2, "X" if i < 15 else "Y", "EACH", 20.0 if i < 15 else 10.0) for i in range(11, 21)]
    assert [tuple(r) for r in reports.worst_units(spark.createDataFrame(rows, PRICED)).collect()] == [(1, "X", 2.0, 50.0)]


def test_price_block_and_totals(spark):
    rows = [(i, 1, "A", "EACH", p) for i, p in enumerate((10.0, 12.0, 14.0, 100.0))] + [(9, 1, "A", "KG", 5.0), (10, 2, "A", "KG", -5.0), (11, 2, "A", "KG", None)]
    records = spark.createDataFrame(rows, PRICED)
    from kinfold.plans.queries import price_block

    block = price_block(records).first()
    assert (block["basis_uom"], block["priced"], block["spend"], block["price_median"], block["price_spread"], block["savings"], block["excess"], block["other_records"], block["uom_forms"]) == ("EACH", 4, 136.0, 13.0, 10.0, 96.0, 88.0, 1, 2)
    assert reports.unit_list(records.filter("price > 0")).first()["uom_list"] == "EACH:4|KG:1"
    total = reports.savings(records).first()
    assert (total["families"], total["priced_records"], total["unpriced_records"], total["excess_pct"], total["best_pct"], total["outlier_families"], total["outlier_excess"]) == (1, 4, 3, 64.71, 70.59, 0, 0.0)


def test_sweep_of_three_families(spark):
    clusters = spark.createDataFrame([(1, 0.97, 5), (2, 0.85, 3), (3, 0.60, 2), (4, 0.99, 1)], "family_no long, mean double, members long")
    labels = spark.createDataFrame([(1, "a"), (1, " a "), (2, "a"), (2, "b"), (3, "c"), (4, " "), (4, "nan")], "family_no long, label string")
    at = {r["floor"]: r for r in reports.sweep(labels, clusters).collect()}
    assert len(at) == 45
    r = at[0.9]
    assert (r["auto"], r["review"], r["review_records"], r["auto_share"], r["auto_judged"], r["auto_correct"], r["wrong_caught"], r["wrong_shipped"]) == (2, 2, 5, 0.5, 1, 1.0, 1, 0)
    assert at[0.99]["auto_correct"] is None and at[0.55]["wrong_shipped"] == 1 and at[0.85]["auto"] == 3


def test_stats_of_nothing(spark):
    records = spark.createDataFrame([], "cpse string")
    clusters = spark.createDataFrame([], "family_no long, mean double, members long")
    r = reports.stats(records, clusters).first()
    assert (r["records"], r["families"], r["fan_in"], r["unspecified"]) == (0, 0, 0.0, 0)
    assert reports.distribution(clusters).first()["resolved_pct"] == 0.0


def test_spellings_keep_first_codes_and_units(spark):
    rows = [(i, 1, " nut  m8" if i % 2 else "NUT M8", "NUT M8", "NUT M8", f"U{i % 3}", "" if i == 0 else "K", 1.0 - i / 100) for i in range(6)]
    found = runs.spellings(spark.createDataFrame(rows, "row_id long, family_no long, description string, text string, golden string, cpse string, code string, score double")).collect()
    assert len(found) == 1 and (found[0]["n_records"], found[0]["units"], found[0]["codes"], found[0]["lowest"], found[0]["is_golden"]) == (6, ["U0", "U1", "U2"], ["K", "K", "K"], 0.95, True)


def test_places_in_an_order(spark):
    values = list(range(1000))
    random.Random(1).shuffle(values)
    rows = spark.createDataFrame([(v % 7, v) for v in values], "a long, b long").repartition(9)
    got = [(r["a"], r["b"]) for r in ranking.ranked(rows, [F.desc("a"), F.col("b")], "place").orderBy("place").collect()]
    assert got == sorted(((v % 7, v) for v in values), key=lambda p: (-p[0], p[1]))
    assert ranking.ranked(rows.limit(0), [F.col("b")], "place").count() == 0


@pytest.mark.parametrize("numerator, denominator", [(3, 4), (11, 20), (9, 10)])
def test_rarest_grams_lose_no_edge(spark, numerator, denominator):
    dice = random.Random(numerator)
    words = ["BOLT", "NUT", "M8", "M10", "HEX", "SS", "LONG", "A", ""]
    texts = {i: " ".join(dice.choice(words) for _ in range(dice.randint(1, 5))) for i in range(120)}
    texts[200] = texts[201] = "SAME TEXT"
    grams = {}
    for i, t in texts.items():
        padded = f" {t} "
        for k in range(max(len(padded) - 2, 1)):
            grams.setdefault(i, {})[padded[k : k + 3]] = grams.get(i, {}).get(padded[k : k + 3], 0) + 1
    dot = lambda a, b: sum(n * grams[b].get(g, 0) for g, n in grams[a].items())
    want = {(i, j) for i in grams for j in grams if denominator**2 * dot(i, j) ** 2 >= numerator**2 * dot(i, i) * dot(j, j)}
    made = S.trigrams(spark.createDataFrame(list(texts.items()), "id long, text string"))
    got = S.sparse_edges(made, numerator, denominator).collect()
    assert len(got) == len(want) and {(r["i"], r["j"]) for r in got} == want
    assert all(abs(r["cos"] - dot(r["i"], r["j"]) / (dot(r["i"], r["i"]) * dot(r["j"], r["j"])) ** 0.5) < 1e-12 for r in got)


def test_rarest_grams_compare_few_pairs(spark):
    """Texts that share a word: all pairs share its grams, few share their rarest."""
    dice = random.Random(3)
    texts = [(i, "VALVE " + "".join(dice.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(12))) for i in range(400)]
    few = S.rare_prefixes(S.trigrams(spark.createDataFrame(texts, "id long, text string"))).select("gram", "id")
    pairs = few.join(few.withColumnRenamed("id", "other"), "gram").filter("id < other").select("id", "other").distinct().count()
    assert pairs < 400 * 399 / 2 / 20


def test_dense_edges_of_several_blocks_with_an_encoder(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 40)
    monkeypatch.setattr(dense, "BLOCK", 40)
    texts = [(i, f"{i % 7} {i % 3}") for i in range(150)]

    def encode(some):
        out = np.zeros((len(some), 7))
        for k, t in enumerate(some):
            a, b = map(int, t.split())
            out[k, a], out[k, b] = 2, 1
        return out

    vectors = S.encoded(spark.createDataFrame(texts, "id long, text string"), encode, batch=16)
    x = encode([t for _, t in texts])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.75 - 1e-12))}
    got = [(r["i"], r["j"]) for r in S.dense_edges(vectors, 0.75 - 1e-12).collect()]
    assert len(got) == len(want) and set(got) == want


def test_units_that_compare(spark):
    row = spark.range(1).select(T.comparable(F.lit("m"), F.lit("M")).alias("same"), T.comparable(F.lit("M"), F.lit("FT")).alias("other"), T.dimension_of(F.lit("ft")).alias("known"), T.dimension_of(F.lit("WIDGET")).alias("unknown")).first()
    assert tuple(row) == (True, False, "length", "unknown")


def test_questions(spark, tmp_path):
    asked = spark.createDataFrame([("  why\tso \u0007 many? ", "Ann", "a@b.c"), ("hm", "Bo", ""), ("x" * 2000, None, None)], "question string, name string, email string")
    folder = f"file://{tmp_path}/q"
    questions.append_questions(asked, folder)
    (tmp_path / "q" / "old.json").write_text('{"id": "1", "question": "an old one?", "created_at": "2001-01-01T00:00+00:00"}\nnot json\n')
    got = questions.newest(questions.read_questions(spark, folder)).collect()
    assert len(got) == 3 and got[-1]["question"] == "an old one?" and "email" not in got[0].asDict()
    assert {(len(r["question"]), r["has_email"]) for r in got} == {(14, True), (1000, False), (11, False)}
    assert questions.newest(questions.read_questions(spark, folder), unlocked=True).filter("email = 'a@b.c'").first()["question"] == "why so   many?"


def write_book(path, rows, shared=("Banner", "Item")):
    """A small workbook: a shared string, inline strings, numbers and a truth value; rows by number."""

    def cell(column, number, value):
        at = f'{"ABCDEFGH"[column]}{number}'
        if value is None:
            return ""
        if value in shared:
            return f'<c r="{at}" t="s"><v>{shared.index(value)}</v></c>'
        if isinstance(value, bool):
            return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f'<c r="{at}"><v>{value}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><r><t>{value[:2]}</t></r><r><t xml:space="preserve">{value[2:]}</t></r></is></c>'

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = "".join(f'<row r="{n}">' + "".join(cell(k, n, v) for k, v in enumerate(values)) + "</row>" for n, values in rows.items())
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="one" sheetId="1" r:id="rId7"/><sheet name="two" sheetId="2" r:id="rId8"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId8" Target="worksheets/b.xml"/><Relationship Id="rId7" Target="worksheets/a.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        book.writestr("xl/worksheets/a.xml", f"<worksheet {main}><sheetData>{sheet}</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    path = str(tmp_path / "stock.xlsx")
    write_book(path, {1: ["Banner"], 3: ["Material Description", "Plant", None, "Rate", "Empty"], 4: ["hex bolt m8", "U1", "x", 12.5, None], 6: ["Item", None, None, True, None], 7: ["flat washer", "U2", None, 3, None]})
    table = workbook.read_workbook(spark, path)
    assert table.columns == ["_row", "Material Description", "Plant", "col_2", "Rate"]
    assert [tuple(r)[1:] for r in table.orderBy("_row").collect()] == [("hex bolt m8", "U1", "x", "12.5"), ("Item", None, None, "True"), ("flat washer", "U2", None, "3")]
    (tmp_path / "text.csv").write_text("Description,Plant\nround bar,U3\n")
    (tmp_path / "broken.xlsx").write_bytes(b"PK\x03\x04 nothing")
    united, notes = tables.read_tables(spark, [path, str(tmp_path / "text.csv"), str(tmp_path / "broken.xlsx")])
    assert {(r["description"], r["cpse"]) for r in united.collect()} == {("hex bolt m8", "U1"), ("Item", "UNSPECIFIED"), ("flat washer", "U2"), ("round bar", "U3")}
    assert len(notes) == 1 and "broken.xlsx" in notes[0]


def dated_book(path, rows, dimension, since_1904=False):
    """A workbook of numbers in styles: plain, a date with a number, one with a code, a time, money, elapsed hours; with a name-space prefix."""
    main = 'xmlns:x="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    codes = {164: "yyyy\\-mm\\-dd", 165: '#,##0.00 "days"', 166: "[h]:mm", 167: "[Red]0.0;[Blue]-0.0"}
    styles = f'<styleSheet {main}><numFmts>' + "".join(f'<numFmt numFmtId="{k}" formatCode="{v.replace(chr(34), "&quot;")}"/>' for k, v in codes.items()) + "</numFmts><cellStyleXfs><xf numFmtId='14'/></cellStyleXfs><cellXfs>" + "".join(f'<xf numFmtId="{k}"/>' for k in (0, 14, 164, 20, 165, 166, 167)) + "</cellXfs></styleSheet>"
    sheet = "".join(f'<x:row r="{n}">' + "".join(f'<x:c r="{"ABCDEFGH"[k]}{n}" s="{style}"><x:v>{v}</x:v></x:c>' if style is not None else f'<x:c r="{"ABCDEFGH"[k]}{n}" t="inlineStr"><x:is><x:t>{v}</x:t></x:is></x:c>' for k, (v, style) in enumerate(cells)) + "</x:row>" for n, cells in rows.items())
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><workbookPr date1904="{int(since_1904)}"/><sheets><sheet name="one" sheetId="1" r:id="rId7"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Target="worksheets/a.xml"/></Relationships>')
        book.writestr("xl/styles.xml", styles)
        book.writestr("xl/worksheets/a.xml", f'<x:worksheet {main}>{dimension}<x:sheetData>{sheet}</x:sheetData></x:worksheet>')


def test_dates_in_a_workbook(spark, tmp_path):
    path = str(tmp_path / "dates.xlsx")
    head = [(n, None) for n in ("Description", "A", "B", "C", "D", "E", "F")]
    dated_book(path, {1: head, 2: [("bolt", None), (45047, 1), (45047.5, 2), (0.75, 3), (45047, 4), (1.5, 5), (2.5, 6)], 3: [("nut", None), (59, 1), (61, 1), (1, 2), (3, 0), (2958466, 1), (-1, 1)]}, "")
    got = [tuple(r)[1:] for r in workbook.read_workbook(spark, path).orderBy("_row").collect()]
    assert got[0] == ("bolt", "2023-05-01 00:00:00", "2023-05-01 12:00:00", "18:00:00", "45047", "1900-01-01 12:00:00", "2.5")
    assert got[1] == ("nut", "1900-02-28 00:00:00", "1900-03-01 00:00:00", "1900-01-01 00:00:00", "3", "2958466", "-1")
    dated_book(path + "m", {1: head[:2], 2: [("bolt", None), (0, 1)]}, "", since_1904=True)
    assert workbook.read_workbook(spark, path + "m").first()[2] == "1904-01-01 00:00:00"


@pytest.mark.parametrize("dimension", ['<x:dimension ref="A1:B400"/>', '<x:dimension ref="A1:B90"/>', "", '<x:dimension ref="A1"/>', '<x:dimension ref="A1:B9000"/>'])
def test_ranges_of_one_sheet(spark, tmp_path, monkeypatch, dimension):
    """Ranges give every row once, whatever the sheet says of its size, whether rows are left out, and wherever chunks are cut."""
    path, rows = str(tmp_path / "rows.xlsx"), {n: [(f"text {n}", None), (n, 0)] for n in range(1, 401) if n % 7}
    dated_book(path, rows, dimension)
    spark.dataSource.register(workbook.SheetSource)
    read = spark.read.format("first_sheet").option("rows", "90").load(path)
    assert sorted((r["_row"], r["cells"]) for r in read.collect()) == [(n - 1, [f"text {n}", str(n)]) for n in rows]
    assert read.rdd.getNumPartitions() == {"A1:B400": 5, "A1:B9000": 100}.get(dimension[18:-3].strip('"'), 1)
    monkeypatch.setattr(workbook, "CHUNK", 37)
    book = workbook.Book(path)
    for first, last in ((1, None), (5, 9), (7, 7), (180, 200), (400, None), (401, None)):
        assert [n for n, _ in book.rows(first, last)] == [n for n in rows if n >= first and (last is None or n <= last)]


def test_a_workbook_that_only_spark_can_reach(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "dates.xlsx")
    dated_book(path, {1: [("Description", None), ("A", None)], 3: [("bolt", None), (45047, 1)]}, "")
    want = workbook.read_workbook(spark, path).collect()

    class Unreachable:
        @staticmethod
        def from_uri(path):
            raise ValueError(path)

    monkeypatch.setattr(workbook.fs, "FileSystem", Unreachable)
    assert workbook.read_workbook(spark, path).collect() == want and len(want) == 1


def test_nothing_left_is_an_error(spark):
    with pytest.raises(tables.TableError):
        tables.fit(spark.range(0))


def test_notes_on_roles(spark):
    chosen = {"description": roles.Choice("Text", "a known name")}
    assert [tuple(r) for r in roles.notes(spark, chosen).collect()] == [("description", "Text", "Text was taken for the description: a known name")]


class Refused(Exception):
    code = 429


def test_paced_transport(monkeypatch):
    clock, waits, calls = [100.0], [], []
    monkeypatch.setattr(enrich.time, "monotonic", lambda: clock[0])
    monkeypatch.setattr(enrich.time, "sleep", lambda s: (waits.append(round(s, 2)), clock.__setitem__(0, clock[0] + s)))

    def transport(prompt):
        calls.append(prompt)
        if len(calls) == 1:
            raise Refused("Please retry in 5.92s.")
        if len(calls) == 2:
            raise OSError("no network")
        return "[]"

    ask = enrich.Paced(transport)
    assert ask("a") == "[]" and ask("b") == "[]"
    assert waits == [6.32, 3.0, 0.2, 3.2]

    class Wrong(Exception):
        code = 400

    def refuses(prompt):
        calls.append(prompt)
        raise Wrong("bad request")

    before = len(calls)
    with pytest.raises(Wrong):
        enrich.Paced(refuses)("c")
    assert len(calls) == before + 1


def test_answers_by_code_and_overlay(spark):
    assert enrich.matched(["FAM_00001", "FAM_00002"], [{"code": "mtl-0000002", "x": 1}], codes=["MTL-0000001", "MTL-0000002"]) == [None, {"code": "mtl-0000002", "x": 1}]
    families = spark.createDataFrame([(1,), (2,)], "family_no long")
    flags = spark.createDataFrame([(1, None, "wrong merge", "two parts", 0.5, None, None), (2, None, "wrong merge", None, None, None, "lost")], enrich.FLAG)
    standards = spark.createDataFrame([(2, *["A"] * len(C.STANDARD_FIELDS), "A, B", 0.9, None)], enrich.STANDARD)
    got = {r["family_no"]: ([f["kind"] for f in r["flags"]], r["standard"]) for r in enrich.overlay(families, flags, standards).collect()}
    assert got == {1: (["wrong merge"], None), 2: ([], "A, B")}
    assert [r["flags"] for r in enrich.overlay(families).collect()] == [[], []]


def test_fingerprint(spark):
    import hashlib

    golden, ways = 'BOLT "M8"', ["b, c", "a\\x", "é"]
    want = hashlib.sha1(json.dumps([golden, sorted(ways)], ensure_ascii=False).encode()).hexdigest()[:16]
    assert spark.createDataFrame([(golden, ways)], "g string, w array<string>").select(enrich.fingerprint(F.col("g"), F.col("w"))).first()[0] == want


def test_cells_with_line_breaks(spark, tmp_path):
    path = str(tmp_path / "broken_lines.csv")
    (tmp_path / "broken_lines.csv").write_bytes(b'Stock list,,\r\n\r\nDescription,Plant,Note\r\n"bolt\r\nhex ""M8""",U1,"a, b"\r\nnut,U2\r\none,two,three,four\r\nwasher,U3,"x\ny"\r\n')
    rows = [tuple(r)[1:] for r in tables.read_table(spark, path).orderBy("_row").collect()]
    assert rows == [('bolt\nhex "M8"', "U1", "a, b"), ("nut", "U2", None), ("washer", "U3", "x\ny")]


def test_merge_plan_counts(spark, tmp_path):
    rows = [(1, "A x", "A X", "U1", "K1", 1, "A X", 1.0), (2, "a  X", "A X", "U2", "", 1, "A X", 1.0), (3, "B LONG", "B LONG", "U1", "", 2, "B LONG", 1.0)]
    records = spark.createDataFrame(rows, "row_id long, description string, text string, cpse string, code string, family_no long, golden string, score double")
    full = records.withColumns({"price": F.lit(None).cast("double"), "uom": F.lit("EACH"), "label": F.lit("")})
    plan = runs.Run.save(full, str(tmp_path), "one").merge_plan(2, 1)
    assert (plan["keeps"], plan["absorbed"], plan["golden"], plan["golden_from"], plan["units"], plan["spellings"], plan["retires"]) == (1, 2, "B LONG", "absorbed", 2, 2, "MTL-0000002")
