"""Progress of running jobs, and stopping them."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Stopped(RuntimeError):
    """A progress callback has asked for the end of a run."""


def tasks_done(spark: SparkSession) -> tuple[int, int]:
    """Tasks that have ended and all tasks of the stages that run now."""
    tracker = spark.sparkContext.statusTracker()
    known = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s is not None]
    return sum(s.numCompletedTasks for s in known), sum(s.numTasks for s in known)


@contextmanager
def watched(spark: SparkSession, progress: Callable[[str], object] | None, every: float = 0.5) -> Iterator[Callable[[str], None]]:
    """Jobs started inside carry a tag of their own; a poller tells ``progress`` how far they are, and
    interrupts all jobs of the tag once it returns False. Yields a function that names the stage of
    the run, which asks as well. A run that was stopped ends in ``Stopped``."""
    if progress is None:
        yield lambda stage: None
        return
    tag, over, asked, now = f"lumigrid-{uuid.uuid4().hex}", threading.Event(), threading.Event(), [""]

    def poll() -> None:
        while not over.wait(every):
            done, total = tasks_done(spark)
            if not asked.is_set() and total and progress(f"{now[0]}: {done} of {total} tasks") is False:
                asked.set()
            if asked.is_set():  # a driver between two jobs may start another
                spark.sparkContext.cancelJobsWithTag(tag)

    def tell(stage: str) -> None:
        now[0] = stage
        if asked.is_set() or progress(stage) is False:
            raise Stopped(f"stopped at {stage}")

    poller = threading.Thread(target=poll, daemon=True)
    spark.sparkContext.addJobTag(tag)
    poller.start()
    try:
        yield tell
    except Exception as why:
        if asked.is_set() and not isinstance(why, Stopped):
            raise Stopped(f"stopped at {now[0]}") from why
        raise
    finally:
        over.set()
        poller.join()
        spark.sparkContext.removeJobTag(tag)
