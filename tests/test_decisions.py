"""Decisions on a small run, sources with awkward headers, roles, sampling, independent sets and the stream."""

import random

import pytest

from kinfold import constants as C
from kinfold.operators import graph, runs
from kinfold.operators import similarity as S
from kinfold.plans import decisions
from kinfold.sources import roles, tables
from kinfold.streaming import assign

ROWS = [
    (1, "BOLT HEX M10", 1, "BOLT HEX M10 LONG", 0.9), (2, "BOLT HEX M10 LONG", 1, "BOLT HEX M10 LONG", 1.0), (3, "BOLT M10", 1, "BOLT HEX M10 LONG", 0.6),
    (4, "NUT M12", 2, "NUT M12", 1.0), (5, "GASKET", 3, "GASKET", 1.0), (6, "GASKET", 3, "GASKET", 1.0),
]


@pytest.fixture
def run(spark, tmp_path):
    rows = [(i, text.lower(), text, f"U{i % 2}", 10.0 * i, "EACH", "", f, g, s) for i, text, f, g, s in ROWS]
    schema = "row_id long, description string, text string, cpse string, price double, uom string, label string, family_no long, golden string, score double"
    return runs.Run.save(spark.createDataFrame(rows, schema), str(tmp_path), "first")


def families(run):
    return {r["family_no"]: r.asDict() for r in run.families().collect()}


def test_split_merge_and_undo(run):
    before = sorted(map(tuple, run.records().collect()))
    run.approve(1, by='  Ann, "A" ')
    assert families(run)[1]["approved"]
    with pytest.raises(runs.ReviewError):
        run.approve(1)
    run.split(1)
    got = families(run)
    assert got[4]["golden"] == "BOLT M10" and got[4]["mean"] == 1.0 and got[4]["status"] == "review" and got[4]["split_from"] == 1
    assert got[1]["members"] == 2 and got[1]["status"] == "review" and got[1]["approved"]
    run.merge(4, 1)
    got = families(run)
    assert 4 not in got and got[1]["members"] == 3 and not got[1]["approved"]
    assert [r["family_no"] for r in run.review_states().orderBy("family_no").collect()] == [1, 4]
    assert run.undo() == 3 and run.undo() == 2
    assert sorted(map(tuple, run.records().collect())) == before
    assert [(r["verb"], r["undone"], r["by"]) for r in run.log().orderBy("seq").collect()] == [("approve", False, "Ann A"), ("split", True, ""), ("merge", True, "")]
    assert {r["family_no"]: r["state"] for r in run.review_states().collect()} == {1: "confirmed"}
    said = run.summary().first().asDict()
    assert said.pop("first_at") < said.pop("last_at") and said.pop("undoable_summary") == "family 1 approved"
    assert said == {"logged": 3, "live": 1, "undone": 2, "approve": 1, "split": 0, "merge": 0, "records_touched": 3, "undoable_seq": 1}
    assert [tuple(r) for r in run.reviewers().collect()] == [("Ann A", 1)]


def test_refused_decisions(run):
    for wrong in (lambda: run.split(2), lambda: run.split(3), lambda: run.split(9), lambda: run.merge(1, 1), lambda: run.merge(1, 9), run.undo):
        with pytest.raises(runs.ReviewError):
            wrong()


def test_two_decisions_at_once(run):
    """A number is given once: who comes second is told to look again."""
    run.approve(1)
    seen = run._head()
    run.approve(2)
    with pytest.raises(runs.ReviewError, match="same time"):
        run._record(seen, "approve", 3, None, 1, "", "")
    assert run.log().count() == 2 and run._record(run._head(), "approve", 3, None, 1, "", "") == 3


def test_approve_plan(run):
    plan = run.approve_plan(1)
    assert (plan["records"], plan["more"], sum(s["n_records"] for s in plan["spellings"])) == (3, 0, 3)
    assert plan["concerns"] == [] or plan["score"] < 0.82
    run.approve(1)
    with pytest.raises(runs.ReviewError):
        run.approve_plan(1)


def test_saved_runs(spark, run, tmp_path):
    assert runs.usage(spark, str(tmp_path / "none"))["enabled"] is False
    runs.Run.save(run.records(), str(tmp_path), "second")
    used = runs.usage(spark, str(tmp_path))
    assert used["runs"] == 2 and used["bytes"] > 1000
    with pytest.raises(runs.ReviewError):
        runs.Run.save(run.records(), str(tmp_path), "second")
    (tmp_path / "broken").mkdir()
    assert [r["run"] for r in runs.saved_runs(spark, str(tmp_path)).collect()] == ["second", "first"]
    assert runs.forget(spark, str(tmp_path), keep=1) == ["first"] and not (tmp_path / "first").exists()


def test_sampling_in_turns(spark):
    rows = [(1, f"{w} x", 0.9, "U", i) for i, w in enumerate("aaaaabbc")]
    got = graph.sampled(spark.createDataFrame(rows, "family_no long, description string, score double, cpse string, row_id long"), 6)
    assert [r["spelling"] for r in got.orderBy("place").collect()] == ["C X", "B X", "A X", "B X", "A X", "A X"]
    assert graph.per_family(900) == 5 and graph.per_family(1) == 40


def test_independent_seeds(spark):
    dice = random.Random(5)
    for n in (0, 5, 40):
        near = {(i, i) for i in range(n)} | {p for i in range(n) for j in range(i) if (n == 5 and i - j == 1) or (n > 5 and dice.random() < 0.1) for p in ((i, j), (j, i))}
        deg = {i: sum((i, j) in near for j in range(n)) for i in range(n)}
        want, seeds = {}, []
        for i in sorted(range(n), key=lambda i: (-deg[i], i)):
            if i not in want:
                seeds.append(i)
                want |= {j: i for j in range(n) if (i, j) in near and j not in want}
        got = S.communities_mis(spark.createDataFrame(list(near), "i long, j long"))
        assert {r["member"]: r["seed"] for r in got.collect()} == want


def test_header_and_separator():
    lines = ["MATERIAL MASTER", "", "as of; today", "Code;Short Text;Price", "1;a b;2"]
    found = tables.find_layout(lines)
    assert (found.skip, found.separator, found.columns) == (3, ";", ("Code", "Short Text", "Price"))
    assert tables.find_layout(["F1,F2", "a,b"]).skip == 0
    assert tables.unique_names(["a", "", "a", "a"]) == ("a", "Unnamed: 1", "a.1", "a.2")
    with pytest.raises(tables.TableError):
        tables.find_layout(["one", "two"])


def test_files_are_united(spark, tmp_path):
    a, b, c = tmp_path / "IOCL.csv", tmp_path / "b.txt", tmp_path / "c.csv"
    a.write_bytes('﻿extract\n\nDescription,Material Code\n"HEX BOLT, M10",7\nNUT,8,9,10\nWASHER\n'.encode())
    b.write_bytes("WERKS\tMAKTX\tNETPR\tMEINS\nP1\tbolt é long\t1,200.50\tNOS\nP1\tbolt hex short\t4\tKG\nP2\t?\t5\tEA\nP1\tbolt hex short\t4\tKG\n".encode("cp1252"))
    c.write_bytes(b"\x89PNG....")
    table, notes = tables.read_tables(spark, [str(a), str(b), str(c)])
    rows = [tuple(r)[1:] for r in table.orderBy("row_id").collect()]
    assert rows[:2] == [("HEX BOLT, M10", "IOCL", "7", None, "UNSPECIFIED", "", "IOCL"), ("WASHER", "IOCL", "", None, "UNSPECIFIED", "", "IOCL")]
    assert [(r[0], r[3]) for r in rows[2:]] == [("bolt é long", 1200.5), ("bolt hex short", 4.0), ("?", 5.0), ("bolt hex short", 4.0)]
    assert len(notes) == 1 and "PNG" in notes[0]
    kept, counts = tables.clean(table)
    assert counts.first().asDict() == {"rows_in": 6, "rows_blank": 0, "rows_duplicate": 1, "rows_junk": 1, "records": 4} and kept.count() == 4
    with pytest.raises(tables.TableError):
        tables.read_tables(spark, [str(c)])


def test_roles(spark):
    rows = [(f"P{i % 2}", f"10{i}", f"bolt hex size {i}", ("NOS", "KG")[i % 2], f"{i}.50", f"g{i // 3}") for i in range(60)]
    frame = spark.createDataFrame(rows, "WERKS string, MATNR string, MAKTX string, MEINS string, NETPR string, gold_group string")
    known = roles.profiles(frame)
    assert {r: c.column for r, c in roles.infer(known).items()} == {"description": "MAKTX", "unit": "WERKS", "code": "MATNR", "price": "NETPR", "measure": "MEINS", "label": "gold_group"}
    assert known["NETPR"].numeric == known["NETPR"].fractional == 1.0
    plain = frame.select(frame.MAKTX.alias("F1"), frame.WERKS.alias("Plant"), frame.MEINS.alias("F2"))
    assert roles.infer(roles.profiles(plain))["description"].column == "F1"
    owner = frame.select("MAKTX", frame.MEINS.alias("Plant"))
    assert "unit" not in roles.infer(roles.profiles(owner))
    two = frame.select(frame.MAKTX.alias("F1"), frame.MAKTX.alias("F2"))
    assert roles.infer(roles.profiles(two)) == {}
    assert roles.profiles(frame.limit(0))["MAKTX"].n == 0


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "bolt hex m10"), (2, None), (3, "zzzz"), (4, "bolt hex m10")], "row_id long, description string").write.parquet(str(source))
    known = spark.createDataFrame([(1, "BOLT HEX M10 LONG"), (2, "NUT")], "family_no long, golden string")
    arriving = spark.readStream.schema("row_id long, description string").parquet(str(source))
    assign.start(arriving, known, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = {r["row_id"]: (r["family_no"], r["merges"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (1, True), 2: (None, False), 3: (None, False), 4: (1, True)}
    assert C.SIMILARITY_THRESHOLD == 0.75


def test_a_decision_too_large_to_undo_takes_force(spark, run, monkeypatch):
    monkeypatch.setattr(C, "REVERSIBLE_ROWS", 0)
    before = sorted(map(tuple, run.records().collect()))
    run.merge(1, 2)
    with pytest.raises(runs.ReviewError):
        run.undo()
    assert run.undo(by="Cy", force=True) == 1 and sorted(map(tuple, run.records().collect())) == before
    assert [(r["reversible"], r["undone"], r["undone_by"]) for r in run.log().collect()] == [(False, True, "Cy")]


def test_queries_undo_decisions_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(C, "REVERSIBLE_ROWS", 0)  # as the merge of a table with large families
    log = decisions.decision_log(spark, "/root/testdata/sf0.001").orderBy("seq").collect()
    assert [(r["verb"], r["reversible"], r["undone"]) for r in log] == [("approve", True, False), ("split", False, False), ("merge", False, True)]
    assert decisions.undo_restores(spark, "/root/testdata/sf0.001").filter("status IS NULL OR approved OR split_from IS NOT NULL").isEmpty()


def test_summary_after_a_large_decision_is_undone(spark, monkeypatch):
    monkeypatch.setattr(C, "REVERSIBLE_ROWS", 0)
    said = decisions.decision_summary(spark, "/root/testdata/sf0.001").first().asDict()
    touched = said.pop("records_touched")
    assert touched > 0 and said == {"logged": 3, "live": 2, "undone": 1, "approve": 1, "split": 1, "merge": 0, "undoable_seq": None}


def test_audited_mapping_after_a_large_decision_is_undone(spark, monkeypatch):
    monkeypatch.setattr(C, "REVERSIBLE_ROWS", 0)
    found = decisions.export_audited(spark, "/root/testdata/sf0.001").collect()
    assert len(found) == decisions.materials(spark, "/root/testdata/sf0.001").count() and {r["Merged_From"] for r in found} == {""}
    by = {r["Review_State"]: r["Reviewed_By"] for r in found}
    assert by == {"unreviewed": "", "confirmed": "Ann", "split": "Bo B"} and sum(r["Split_From"] != "" for r in found) > 0


def test_review_states_after_a_large_decision_is_undone(spark, monkeypatch):
    monkeypatch.setattr(C, "REVERSIBLE_ROWS", 0)
    found = decisions.review_states(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r["state"], r["by"], r["merged_from"] is None) for r in found) == [("confirmed", "Ann", True), ("split", "Bo B", True), ("split", "Bo B", True)]
