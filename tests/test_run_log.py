"""The log of a run: crashes at each step, bases, and reading as of a decision."""

import os

import pytest

from kinfold.operators import runs
from kinfold.operators.eventlog import Folder

SCHEMA = "row_id long, description string, text string, cpse string, price double, uom string, label string, family_no long, golden string, score double"


@pytest.fixture
def run(spark, tmp_path):
    rows = [(i, f"x{i}", f"BOLT M{i}", f"U{i % 2}", 1.0 * i, "EACH", "", 1 + i // 4, f"BOLT M{i // 4 * 4}", 1.0 if i % 4 == 0 else 0.9 - i % 4 / 5) for i in range(16)]
    return runs.Run.save(spark.createDataFrame(rows, SCHEMA), str(tmp_path), "one")


def state(run):
    return sorted(map(tuple, run.records().collect()))


class Crash(Exception):
    pass


def crash(*_, **__):
    raise Crash


def test_a_crash_before_a_decision_is_published(run, monkeypatch):
    before = state(run)
    with monkeypatch.context() as m:
        m.setattr(Folder, "publish", crash)  # moves and the decision are written, the name isn't given
        for decide in (lambda: run.approve(1), lambda: run.split(1, force=True), lambda: run.merge(1, 2)):
            with pytest.raises(Crash):
                decide()
    assert state(run) == before and run.log().count() == 0
    with monkeypatch.context() as m:
        m.setattr(Folder, "put", crash)  # not even written
        with pytest.raises(Crash):
            run.merge(1, 2)
    assert state(run) == before
    assert run.approve(1) == 1 and run.merge(1, 2) == 2 and state(run) != before
    with monkeypatch.context() as m:
        m.setattr(Folder, "publish", crash)
        with pytest.raises(Crash):
            run.undo()
    assert run.undo() == 2 and state(run) == before


def test_a_torn_decision_locks_nothing(run, tmp_path):
    """An empty file with a number, as a store that breaks its word may leave, is no decision."""
    run.approve(1)
    (tmp_path / "one/events/0000000002.json").write_bytes(b"")
    (tmp_path / "one/events/0000000003.json").write_bytes(b'{"seq": 3, "verb": "mer')
    assert run.approve(2) == 4 and [r["seq"] for r in run.log().orderBy("seq").collect()] == [1, 4]
    assert run.undo() == 4 and run.undo() == 1


def test_a_crash_while_a_base_is_written(run, monkeypatch):
    run.merge(1, 2)
    want = state(run)
    with monkeypatch.context() as m:
        m.setattr(Folder, "publish", crash)
        with pytest.raises(Crash):
            run.fold()
    assert state(run) == want and Folder(run.spark, run.path).names("bases") == []
    assert run.fold() == 1 and state(run) == want and len(Folder(run.spark, run.path).names("bases")) == 1
    assert run.fold() == 1 and len(Folder(run.spark, run.path).names("bases")) == 1


def test_a_crash_while_a_run_is_saved(spark, run, tmp_path, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(Folder, "publish", crash)
        with pytest.raises(Crash):
            runs.Run.save(run.records(), str(tmp_path), "two")
    assert [(r["run"], r["decisions"]) for r in runs.saved_runs(spark, str(tmp_path)).collect()] == [("one", 0)]
    used = runs.usage(spark, str(tmp_path))
    assert used["runs"] == 1 and len(used["warnings"]) == 1 and "never finished" in used["warnings"][0]
    runs.Run.save(run.records(), str(tmp_path), "two")
    run.approve(1)
    assert {r["run"]: r["decisions"] for r in runs.saved_runs(spark, str(tmp_path)).collect()} == {"one": 1, "two": 0}
    assert runs.saved_runs(spark, str(tmp_path / "nowhere")).collect() == []
    assert runs.forget(spark, str(tmp_path), keep=2) == []


def test_undo_through_a_base(run):
    first = state(run)
    run.merge(1, 2)
    merged = state(run)
    run.split(3, force=True)
    split = state(run)
    run.fold()
    assert state(run) == split
    run.approve(4)
    assert run.undo() == 3 and state(run) == split
    assert run.undo() == 2 and state(run) == merged  # the base holds a decision that is undone now
    run.fold()
    assert state(run) == merged and run.undo() == 1 and state(run) == first
    assert [r["undone"] for r in run.log().orderBy("seq").collect()] == [True] * 3
    # As it stood after each decision, before the next one; all undoing came after the third.
    assert [state(run.as_of(n)) for n in (0, 1, 2, 3)] == [first, merged, split, first]
    assert run.as_of(2).log().count() == 2 and run.as_of(2).live().count() == 2
    with pytest.raises(runs.ReviewError, match="past"):
        run.as_of(1).approve(1)


def test_a_thousand_decisions(run):
    """What a read begins with stays short, and the whole log can still be read."""
    for head in range(1000):
        run._record(head, "approve", 1 + head % 4, None, 1, "", "Ann")
    numbers, undone = run._numbers(), run._undone()
    since, base = run._base(numbers, undone)
    assert len(numbers) == 1000 and base and 1000 - since < runs.FOLD
    assert run.log().count() == 1000 and run.undo() == 1000 and run.live().count() == 999
    assert len(state(run)) == 16 and len(run._numbers()) - run._base(run._numbers(), run._undone())[0] < runs.FOLD


def test_one_of_two_gets_a_name(spark, tmp_path):
    home = Folder(spark, f"file://{tmp_path}")
    assert home.put("a/1.json", {"who": 1}) and not home.put("a/1.json", {"who": 2})
    assert os.listdir(tmp_path / "a") == ["1.json"] and (tmp_path / "a/1.json").read_text() == '{"who": 1}'
    for who in ("x", "y"):
        (tmp_path / f".{who}").mkdir()
        (tmp_path / f".{who}" / "f").write_text(who)
    assert home.publish(".x", "b") and not home.publish(".y", "b") and (tmp_path / "b/f").read_text() == "x" and not (tmp_path / ".y").exists()
