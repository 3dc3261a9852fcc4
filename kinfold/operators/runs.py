"""Runs and the decisions people take on them: approve, split, merge, undo.

A run is a folder: the records as unified, written once as Parquet, and what
decisions append.  A decision is one JSON file, ``events/<number>``, published
whole and only if the number is free: it is the one after what the decision
was taken on, so of two people who decide at once one is told to look again.
For a split or a merge there are also the rows it moves, in a folder of their
own, with their new family, golden text and score.  The records as they stand
are the first records with each row's last live move laid over them, so a
decision costs what it touches and not the run, and an undone decision is one
whose moves no longer count: what stood before comes back exactly.

After every ``FOLD`` decisions what stands is written as a base, beside the
log so far.  Later reads begin with the newest base none of whose decisions
was undone since, and read only what came after.  Bases are never needed:
first records and moves stay, so ``as_of`` shows a run as it stood after any
decision, and a crash while a base is written loses nothing.

Decisions are taken by people, so the log is small and may be read by the
driver; records and moves never are.  A crash leaves hidden files, or moves no
decision names; neither counts.  A file of a number that can't be read (torn by
a store that breaks its word) is no decision, and its number isn't given again.

Families split or merged by hand are capped at ``review`` until approved.
Undo takes back the last live decision only.  A decision that moved very many
records is undone by force alone.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from . import similarity as S
from .eventlog import Folder

#: Decisions after which what stands is written as a base.
FOLD = 64
FORMAT = 2
EVENT = "seq long, at timestamp, by string, verb string, family_no long, related_no long, affected long, summary string, reversible boolean, moves string"
MOVE = "moves string, row_id long, family_no long, golden string, score double"
UNDONE = "seq long, at timestamp, by string, after long"
RECORD = ("row_id", "description", "text", "cpse", "code", "price", "uom", "label", "family_no", "golden", "score")


class ReviewError(Exception):
    """A decision that can't be taken, with a reason to show."""


def family_id(number: Column) -> Column:
    return F.concat(F.lit("FAM_"), _padded(number, 5))


def family_code(number: Column) -> Column:
    return F.concat(F.lit(f"{C.CODE_PREFIX}-"), _padded(number, 7))


def _padded(number: Column, width: int) -> Column:
    text = number.cast("string")
    return F.when(F.char_length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def clean_name(name: str | None) -> str:
    """A reviewer's name: white space squeezed, no commas or quotes, 64 characters at most."""
    return " ".join((name or "").replace(",", " ").replace('"', " ").split())[: C.MAX_NAME]


def rescored(rows: DataFrame, golden: str) -> DataFrame:
    """``rows`` with ``golden`` and ``score``: the trigram cosine of each row's text to it."""
    spark = rows.sparkSession
    texts = rows.select(F.col("text").alias("id"), "text").distinct()
    one = S.trigrams(spark.range(1).select("id", F.lit(golden).alias("text"))).select("gram", F.col("n").alias("ng"), F.col("norm2").alias("qg"))
    dots = S.trigrams(texts).join(F.broadcast(one), "gram").groupBy(F.col("id").alias("text"))  # one text's trigrams
    cos = dots.agg((F.sum(F.col("n") * F.col("ng")) / F.sqrt((F.first("norm2") * F.first("qg")).cast("double"))).alias("cos"))
    score = F.round(F.least(F.coalesce("cos", F.lit(0.0)), F.lit(1.0)), 4)
    return rows.drop("golden", "score").join(cos, "text", "left").withColumn("score", score).withColumn("golden", F.lit(golden)).drop("cos")


@dataclass(frozen=True)
class Run:
    """A saved run; the tables are read anew on each call, so it always shows what stands now."""

    spark: SparkSession
    path: str
    #: Show the run as it stood after this decision; None: now.
    upto: int | None = None

    # -- storage

    @classmethod
    def save(cls, records: DataFrame, root: str, name: str | None = None, stats: dict | None = None) -> Run:
        """Write a run's records under ``root``, aside first, then under its name, which must be new."""
        spark, name, home = records.sparkSession, name or uuid.uuid4().hex, Folder(records.sparkSession, root)
        aside = home.aside(name)
        full = records if "code" in records.columns else records.withColumn("code", F.lit(""))
        full.select(*RECORD).write.parquet(f"{home.path}/{aside}/records")
        home.write(f"{aside}/manifest/run.json", {"format": FORMAT, "created": time.time(), "stats": stats or {}})
        if not home.publish(aside, name):
            raise ReviewError(f"there is a run {name} already")
        return cls(spark, f"{home.path}/{name}")

    @property
    def _home(self) -> Folder:
        return Folder(self.spark, self.path)

    def as_of(self, seq: int) -> Run:
        """The run as it stood before the decision after ``seq`` was taken; no decisions can be taken on it."""
        return replace(self, upto=seq)

    def _numbers(self) -> list[int]:
        """The numbers of the decisions that are shown, whatever became of them."""
        found = [int(n.split(".")[0]) for n in self._home.names("events")]
        return found if self.upto is None else [n for n in found if n <= self.upto]

    def _undone(self) -> list[int]:
        """The numbers of the decisions that had been undone by then."""
        names = self._home.names("undone")
        if self.upto is not None and names:
            rows = self._lines("undone", names, UNDONE).filter(F.coalesce("after", "seq") <= self.upto).select("seq")
            return sorted(r[0] for r in rows.collect())
        return [int(n.split(".")[0]) for n in names]

    def _base(self, numbers: list[int], undone: list[int]) -> tuple[int, str | None]:
        """The last decision and the name of the newest base that holds.

        A base is named by its last decision and how many up to it had been
        undone.  Undone ones never come back, so an equal count is the same set.
        """
        for name in reversed(self._home.names("bases")):
            seq, count = map(int, name.split("-"))
            if seq <= max(numbers, default=0) and count == sum(u <= seq for u in undone):
                return seq, name
        return 0, None

    def _lines(self, folder: str, names: list[str], schema: str) -> DataFrame:
        """The JSON lines of these files of a folder, without those that can't be read."""
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json([f"{self.path}/{folder}/{n}" for n in names]).filter("seq IS NOT NULL")

    # -- what stands

    def log(self) -> DataFrame:
        """Every decision ever taken, with what became of it."""
        home, numbers = self._home, self._numbers()
        told = [(int(n.split("-")[0]), n) for n in home.names("bases") if int(n.split("-")[0]) <= max(numbers, default=0)]
        upto, name = max(told, default=(0, None))
        events = self._lines("events", [_file(n) for n in numbers if n > upto], EVENT)
        if name:  # whatever was undone since, the decisions themselves are what they were
            events = self.spark.read.schema(EVENT).parquet(f"{self.path}/bases/{name}/log").unionByName(events)
        undone = self._lines("undone", [_file(n) for n in self._undone()], UNDONE).select("seq", F.col("at").alias("undone_at"), F.col("by").alias("undone_by"))
        return events.join(undone, "seq", "left").withColumn("undone", F.col("undone_at").isNotNull())

    def live(self) -> DataFrame:
        return self.log().filter("NOT undone")

    def records(self) -> DataFrame:
        numbers, undone = self._numbers(), self._undone()
        since, base = self._base(numbers, undone)
        first = self.spark.read.parquet(f"{self.path}/bases/{base}/records" if base else f"{self.path}/records")
        later = [_file(n) for n in numbers if n > since and n not in set(undone)]
        # FOLD decisions at most, unless some were undone since the last base.
        named = self._lines("events", later, EVENT).filter("moves IS NOT NULL").select("seq", "moves").collect()
        if not named:
            return first.select(*RECORD)
        moves = self.spark.read.schema(MOVE).parquet(*[f"{self.path}/moves/{r['moves']}" for r in named])
        order = self.spark.createDataFrame(named, "seq long, moves string")
        last = moves.join(F.broadcast(order), "moves").groupBy("row_id").agg(F.max_by(F.struct("family_no", "golden", "score"), "seq").alias("m"))
        columns = [F.coalesce(F.col(f"m.{c}"), F.col(c)).alias(c) if c in ("family_no", "golden", "score") else F.col(c) for c in RECORD]
        return first.join(last, "row_id", "left").select(*columns)

    def fold(self) -> int:
        """Write what stands now, and the log, as a base; the number of its last decision."""
        if self.upto is not None:
            raise ReviewError("a run of the past can't be changed")
        home, numbers, undone = self._home, self._numbers(), self._undone()
        seq = max(numbers, default=0)
        name = f"bases/{seq:010d}-{sum(u <= seq for u in undone):010d}"
        if seq and name.split("/")[1] not in home.names("bases"):
            aside, then = home.aside(name), self.as_of(seq)
            then.records().write.parquet(f"{self.path}/{aside}/records")
            then.log().select(*[c.split()[0] for c in EVENT.split(", ")]).coalesce(1).write.parquet(f"{self.path}/{aside}/log")
            if sum(u <= seq for u in self._undone()) == int(name[-10:]):  # else it is a base of what stands no more
                home.publish(aside, name)
            else:
                home.delete(aside)
        return seq

    def families(self) -> DataFrame:
        """family_no, golden, members, units, mean, lowest, status, approved, split_from of the families that stand."""
        core = self.records().groupBy("family_no", "golden").agg(F.count(F.lit(1)).alias("members"), F.countDistinct("cpse").alias("units"), F.avg("score").alias("mean"), F.min("score").alias("lowest"))
        marks = self._marks()
        plain = T.status(F.col("mean"))
        capped = F.when(F.coalesce("touched", F.lit(False)) & plain.isin("resolved", "accepted"), "review").otherwise(plain)
        return core.join(marks, "family_no", "left").withColumns({"status": capped, "approved": F.coalesce("approved", F.lit(False))}).drop("touched")

    def _marks(self) -> DataFrame:
        """What live decisions say of a family: approved unless merged since, touched, the family it was split from."""
        events = self.live()
        sides = events.select("seq", "verb", F.explode(F.array(F.struct(F.col("family_no").alias("f"), F.lit(True).alias("first"), F.col("related_no").alias("o")), F.struct(F.col("related_no").alias("f"), F.lit(False).alias("first"), F.col("family_no").alias("o")))).alias("s")).filter("s.f IS NOT NULL").select("seq", "verb", "s.*")
        verdict = F.max_by(F.col("verb") == "approve", F.when(((F.col("verb") == "approve") | (F.col("verb") == "merge")) & F.col("first"), F.col("seq")))
        origin = F.max_by(F.col("o"), F.when((F.col("verb") == "split") & ~F.col("first"), F.col("seq")))
        return sides.groupBy(F.col("f").alias("family_no")).agg(verdict.alias("approved"), F.bool_or(F.col("verb").isin("split", "merge")).alias("touched"), origin.alias("split_from"))

    def pending(self) -> DataFrame:
        """Families that wait for a person."""
        return self.families().filter(F.col("status").isin("review", "conflict") & ~F.col("approved"))

    def review_states(self) -> DataFrame:
        """family_no, state, at, by, merged_from, split_from of the families decided on: the last live decision that names each."""
        events = self.live()
        named = events.withColumn("f", F.explode(F.array_compact(F.array("family_no", F.when(F.col("verb") == "split", F.col("related_no"))))))
        state = F.create_map(*[F.lit(x) for pair in (("approve", "confirmed"), ("split", "split"), ("merge", "merged")) for x in pair])
        last = F.max_by(F.struct(F.element_at(state, F.col("verb")).alias("state"), "at", "by"), "seq").alias("s")
        merged = F.max_by("related_no", F.when(F.col("verb") == "merge", F.col("seq"))).alias("merged_from")
        origin = F.max_by("family_no", F.when((F.col("verb") == "split") & (F.col("f") == F.col("related_no")), F.col("seq"))).alias("split_from")
        return named.groupBy(F.col("f").alias("family_no")).agg(last, merged, origin).select("family_no", "s.*", "merged_from", "split_from")

    def summary(self) -> DataFrame:
        """One row: decisions logged, live, undone, of each verb, and records touched."""
        standing = ~F.col("undone")
        counts = [F.count_if(standing & (F.col("verb") == v)).alias(v) for v in C.VERBS]
        last = F.max_by(F.struct("seq", "summary"), F.when(standing, F.col("seq")))
        undoable = F.when(F.max_by("reversible", F.when(standing, F.col("seq"))), last)
        times = [F.min("at").alias("first_at"), F.max("at").alias("last_at"), undoable["seq"].alias("undoable_seq"), undoable["summary"].alias("undoable_summary")]
        return self.log().agg(*times, F.count(F.lit(1)).alias("logged"), F.count_if(standing).alias("live"), F.count_if(F.col("undone")).alias("undone"), *counts, F.coalesce(F.sum(F.when(standing, F.col("affected"))), F.lit(0)).alias("records_touched"))

    def reviewers(self) -> DataFrame:
        """by, decisions: standing decisions of each person, most first."""
        who = F.when(F.coalesce("by", F.lit("")) == "", C.UNATTRIBUTED).otherwise(F.col("by"))
        return self.live().groupBy(who.alias("by")).agg(F.count(F.lit(1)).alias("decisions")).orderBy(F.desc("decisions"), "by")

    # -- decisions

    def _one(self, number: int) -> Row:
        found = self.families().filter(F.col("family_no") == number).first()
        if found is None:
            raise ReviewError(f"family {number} is not in this run")
        return found

    def _head(self) -> int:
        """The number that a decision is taken on: the last one there is."""
        if self.upto is not None:
            raise ReviewError("a run of the past can't be changed")
        return max(self._numbers(), default=0)

    def _record(self, head: int, verb: str, number: int, related: int | None, affected: int, summary: str, by: str, moves: str | None = None) -> int:
        """Publish a decision taken on what stood after ``head``."""
        seq = head + 1
        reversible = verb == "approve" or affected <= C.REVERSIBLE_ROWS
        event = {"seq": seq, "at": _now(), "by": clean_name(by), "verb": verb, "family_no": number, "related_no": related, "affected": affected, "summary": summary, "reversible": reversible, "moves": moves}
        if not self._home.put(f"events/{_file(seq)}", event):
            raise ReviewError("someone else decided at the same time; look again and repeat")
        if seq % FOLD == 0:
            self.fold()
        return seq

    def approve(self, number: int, by: str = "") -> int:
        """Accept a family as it is."""
        head, family = self._head(), self._one(number)
        if family["approved"]:
            raise ReviewError(f"family {number} is approved already")
        return self._record(head, "approve", number, None, family["members"], f"family {number} approved", by)

    def approve_plan(self, number: int) -> dict:
        """What approving a family would sign off: its figures, its first spellings and what speaks against it."""
        family = self._one(number)
        if family["approved"]:
            raise ReviewError(f"family {number} is approved already")
        ways = spellings(self.records().filter(F.col("family_no") == number))
        shown = ways.orderBy(F.desc("n_records"), "lowest", "first_row").limit(C.PREVIEW_SPELLINGS)
        rows, found = [r.asDict() for r in shown.collect()], ways.count()
        doubts = []
        if family["mean"] < C.ACCEPT_FLOOR:
            doubts.append(f"its score of {family['mean']:.2f} is below the floor of {C.ACCEPT_FLOOR:.2f}")
        if len(rows) > C.MANY_SPELLINGS:
            doubts.append(f"{len(rows)} spellings or more stand for it")
        return {"family_no": number, "golden": family["golden"], "records": family["members"], "units": family["units"], "score": family["mean"], "status": family["status"], "spellings": rows, "more": found - len(rows), "concerns": doubts}

    def split_plan(self, number: int) -> Row:
        """The seam of a family: p, q (ten-thousandths), below, members, weak."""
        family = self._one(number)
        if family["members"] < 2:
            raise ReviewError("a single record has nothing to be split from")
        found = seams(self.records().filter(F.col("family_no") == number)).withColumn("weak", weak(F.col("p"), F.col("q"))).first()
        if found is None:
            raise ReviewError("every record has the same score, so there is no seam")
        return found

    def split(self, number: int, force: bool = False, by: str = "") -> int:
        """Give the records below the widest gap a family of their own, scored against its own golden text."""
        head, plan = self._head(), self.split_plan(number)
        if plan["weak"] and not force:
            raise ReviewError("the seam is weak; it takes force to cut there")
        records = self.records()
        new = records.agg(F.max("family_no")).first()[0] + 1
        leaving = records.filter((F.col("family_no") == number) & (F.round(F.col("score") * 10000) <= plan["p"]))
        golden = leaving.agg(F.max_by("text", F.struct(F.char_length("text"), "score", -F.col("row_id")))).first()[0]
        moves = self._move(rescored(leaving, golden), new)
        return self._record(head, "split", number, new, plan["below"], f"{plan['below']} records split from family {number} into {new}", by, moves)

    def merge_plan(self, left: int, right: int) -> dict:
        """The family that keeps its number (the larger, ties to the first named), the other, and the golden text of both."""
        if left == right:
            raise ReviewError("a family can't be merged with itself")
        keeps, goes = self._one(left), self._one(right)
        if goes["members"] > keeps["members"]:
            keeps, goes = goes, keeps
        both = self.records().filter(F.col("family_no").isin(keeps["family_no"], goes["family_no"]))
        order = F.struct(F.char_length("text"), F.col("family_no") == keeps["family_no"], "score", -F.col("row_id"))
        golden = both.agg(F.max_by("text", order)).first()[0]
        origin = "keeps" if golden == keeps["golden"] else "absorbed" if golden == goes["golden"] else "members"
        counts = both.agg(F.countDistinct(F.when(F.coalesce("cpse", F.lit("")) != "", F.col("cpse"))).alias("units"), F.countDistinct(T.squeezed(F.col("description"))).alias("n")).first()
        return {
            "keeps": keeps["family_no"], "absorbed": goes["family_no"], "golden": golden, "golden_from": origin, "records": keeps["members"] + goes["members"], "moved": goes["members"],
            "units": counts["units"], "spellings": counts["n"], "scores": (keeps["mean"], goes["mean"]), "retires": f"{C.CODE_PREFIX}-{goes['family_no']:07d}",
        }

    def merge(self, left: int, right: int, by: str = "") -> int:
        """Fold the smaller family into the larger and score all of it against the golden text of both."""
        head, plan = self._head(), self.merge_plan(left, right)
        both = self.records().filter(F.col("family_no").isin(plan["keeps"], plan["absorbed"]))
        moves = self._move(rescored(both, plan["golden"]), plan["keeps"])
        return self._record(head, "merge", plan["keeps"], plan["absorbed"], plan["moved"], f"family {plan['absorbed']} merged into {plan['keeps']}", by, moves)

    def _move(self, rows: DataFrame, number: int) -> str:
        """Append moves before the decision that names them: moves that no live decision names count for nothing."""
        name = uuid.uuid4().hex
        rows.select(F.lit(name).alias("moves"), "row_id", F.lit(number).cast("long").alias("family_no"), "golden", "score").write.parquet(f"{self.path}/moves/{name}")
        return name

    def undo(self, by: str = "", force: bool = False) -> int:
        """Take back the last live decision; it stays in the log, marked.

        One that moved more than ``REVERSIBLE_ROWS`` is marked as not
        reversible and takes force.  What stood before it comes back all the
        same, as the rows it moved and where they were are both kept.
        """
        head, last = self._head(), self.live().orderBy(F.desc("seq")).first()
        if last is None:
            raise ReviewError("nothing to undo")
        if not last["reversible"] and not force:
            raise ReviewError(f"decision {last['seq']} is too large to undo; it takes force")
        if self._head() != head:
            raise ReviewError("someone else decided at the same time; look again and repeat")
        if not self._home.put(f"undone/{_file(last['seq'])}", {"seq": last["seq"], "at": _now(), "by": clean_name(by), "after": head}):
            raise ReviewError("someone else has taken it back")
        return last["seq"]


def _file(seq: int) -> str:
    return f"{seq:010d}.json"


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="microseconds")


def seams(records: DataFrame) -> DataFrame:
    """The widest gap between neighbouring scores of each family, ties to the lower; scores in ten-thousandths."""
    points = records.groupBy("family_no", F.round(F.col("score") * 10000).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    turn = Window.partitionBy("family_no").orderBy("p")
    cuts = points.select("family_no", "p", F.lead("p").over(turn).alias("q"), F.sum("n").over(turn).alias("below"), F.sum("n").over(Window.partitionBy("family_no")).alias("members"))
    best = F.max_by(F.struct("p", "q", "below", "members"), F.struct(F.col("q") - F.col("p"), -F.col("p")))
    return cuts.filter("q IS NOT NULL").groupBy("family_no").agg(best.alias("s")).select("family_no", "s.*")


def spellings(records: DataFrame) -> DataFrame:
    """One row for each way a family is written: spelling, n_records, lowest score, units and codes in the order they are met, a sample, is_golden.

    Codes are the first three that aren't empty, repeated ones too.  Rows are
    counted by spelling, unit and code first, so that a spelling of any number
    of rows reaches no task whole; of each code only its first three rows stay.
    """
    key = T.squeezed(F.col("description"))
    code = F.coalesce("code", F.lit("")) if "code" in records.columns else F.lit("")
    rows = records.select("family_no", key.alias("spelling"), F.coalesce("cpse", F.lit("")).alias("cpse"), code.alias("code"), "row_id", "score", F.left("description", F.lit(C.SAMPLE_LENGTH)).alias("sample"), (F.col("text") == F.col("golden")).alias("is_golden"))
    by = ["family_no", "spelling"]
    one = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_records"), F.min("score").alias("lowest"), F.min("row_id").alias("first_row"), F.min_by(F.struct("sample", "is_golden"), "row_id").alias("f"))
    units = rows.filter("cpse <> ''").groupBy(*by, "cpse").agg(F.min("row_id").alias("at"))
    units = units.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "cpse"))), lambda u: u["cpse"]).alias("units"))  # a unit each
    first = F.row_number().over(Window.partitionBy(*by).orderBy("row_id"))  # Spark keeps three rows a group before the shuffle
    coded = rows.filter("code <> ''").withColumn("k", first).filter(F.col("k") <= C.SHOWN_CODES)
    coded = coded.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "code"))), lambda c: c["code"]).alias("codes"))
    none = F.array().cast("array<string>")
    whole = one.join(units, by, "left").join(coded, by, "left")
    return whole.select(*by, "n_records", "lowest", "first_row", F.coalesce("units", none).alias("units"), F.coalesce("codes", none).alias("codes"), "f.sample", "f.is_golden")


def weak(lower: Column, upper: Column) -> Column:
    """Whether a seam is narrow and all below it match well; scores in ten-thousandths."""
    return (upper - lower < round(C.SPLIT_WEAK_GAP * 10000)) & (lower >= round(C.ACCEPT_FLOOR * 10000))


def saved_runs(spark: SparkSession, root: str) -> DataFrame:
    """run, created, decisions (live ones) of the readable runs under a folder, newest first.

    Runs of another format, without a manifest or half saved are left out; no folder has no runs.
    """
    home = Folder(spark, root)
    named = [n for n in home.names() if home.names(f"{n}/manifest")]  # names only, one for each saved run
    if not named:
        return spark.createDataFrame([], "run string, created timestamp, decisions long")
    counts = spark.createDataFrame([(n, len(home.names(f"{n}/events")) - len(home.names(f"{n}/undone"))) for n in named], "run string, decisions long")
    lines = spark.read.text([f"{home.path}/{n}/manifest" for n in named]).select(F.regexp_extract(F.input_file_name(), r"([^/]+)/manifest/", 1).alias("run"), F.from_json("value", "format int, created double").alias("m"))
    known = lines.filter(F.col("m.format") == FORMAT).select("run", F.col("m.created").cast("timestamp").alias("created"))
    return known.join(counts, "run").orderBy(F.desc("created"), "run")


def usage(spark: SparkSession, root: str, keep: int = C.KEEP_RUNS) -> dict:
    """Runs and bytes under a folder, and what is amiss there; none if there is no such folder."""
    home = Folder(spark, root)
    files = home.files()
    if not files.exists(home.at()):
        return {"enabled": False, "runs": 0, "bytes": 0, "path": root, "keep": keep, "warnings": ["runs aren't kept: there is no folder for them"]}
    named, half = home.names(), [s.getPath().getName() for s in files.listStatus(home.at()) if s.getPath().getName().startswith(".")]
    readable = {r["run"] for r in saved_runs(spark, root).select("run").collect()}  # one row for each saved run
    amiss = [f"{n} can't be read as a run" for n in named if n not in readable] + [f"{n} was never finished" for n in sorted(half)]
    return {"enabled": True, "runs": len(readable), "bytes": files.getContentSummary(home.at()).getLength(), "path": root, "keep": keep, "warnings": amiss}


def forget(spark: SparkSession, root: str, keep: int = C.KEEP_RUNS) -> list[str]:
    """Delete all but the newest ``keep`` runs; the names of those that went."""
    old = [r["run"] for r in saved_runs(spark, root).offset(keep).collect()]  # one row for each saved run
    for name in old:
        Folder(spark, root).delete(name)
    return old
