"""How far a run is, told to a callback while Spark works."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Seconds between two looks.
EVERY = 0.2


def share_done(tracker, group: str) -> tuple[int, int]:
    """Tasks done and tasks known of the jobs of a group."""
    done = known = 0
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage in [tracker.getStageInfo(s) for s in info.stageIds] if info else []:
            if stage:
                done, known = done + stage.numCompletedTasks, known + stage.numTasks
    return done, known


@contextmanager
def reported(spark: SparkSession, callback: Callable[[float, str], None], steps: int = 1) -> Iterator[Callable[[str], None]]:
    """Jobs started inside are one group, and ``callback`` gets (share, step) while they run: from 0 to 1, never less than before.

    The block gets a function that begins the next of ``steps`` steps, by name;
    a step's share grows with the tasks done of those known.  Without steps
    there is one.  An error in the block ends the reports and is passed on.
    """
    context, lock = spark.sparkContext, threading.Lock()
    tracker = context.statusTracker()
    state = {"step": 0, "name": "", "group": uuid.uuid4().hex, "told": -1.0}
    over = threading.Event()

    def tell(share: float) -> None:
        with lock:
            if share > state["told"]:
                state["told"] = share
                callback(share, state["name"])

    def look() -> None:
        done, known = share_done(tracker, state["group"])
        inside = 0.95 * done / known if known else 0.0  # more tasks may become known
        tell(min((max(state["step"] - 1, 0) + inside) / steps, 0.99))

    def watch() -> None:
        while not over.wait(EVERY):
            look()

    def begin(name: str) -> None:
        if state["step"]:
            tell(min(state["step"] / steps, 0.99))
        state.update(step=min(state["step"] + 1, steps), name=name, group=uuid.uuid4().hex)
        context.setJobGroup(state["group"], name)
        look()

    before = [context.getLocalProperty(p) for p in ("spark.jobGroup.id", "spark.job.description")]
    context.setJobGroup(state["group"], "")
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield begin
        tell(1.0)
    finally:
        over.set()
        watcher.join()
        for name, value in zip(("spark.jobGroup.id", "spark.job.description"), before):
            context.setLocalProperty(name, value)
