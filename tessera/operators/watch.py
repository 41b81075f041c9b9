"""Progress and cancellation inside a step: jobs carry a tag, and a thread beside them looks at what they do."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Cancelled(RuntimeError):
    """The caller asked a run to end."""


@contextmanager
def watched(spark: SparkSession, stage: str, progress: Callable[[dict], None], cancelled: Callable[[], bool], every: float = 0.5):
    """Jobs started within are looked at every so many seconds: `progress` is told of their tasks whenever these have
    moved, and once `cancelled` says so they are ended, and the block raises Cancelled. Both are called by a thread of
    their own; an error of theirs ends the block as well."""
    context, tag = spark.sparkContext, f"tessera-{uuid.uuid4().hex}"
    over, wrong = threading.Event(), []

    def look() -> None:
        told = None
        try:
            while not over.wait(every):
                if cancelled():
                    raise Cancelled(f"ended while {stage}")
                now = _tasks(spark, tag)
                if now != told and now[1]:
                    told = now
                    progress({"type": "progress", "stage": stage, "tasks": now[0], "of": now[1]})
        except Exception as e:
            wrong.append(e)
            while not over.is_set():  # jobs that begin meanwhile are ended too
                context.cancelJobsWithTag(tag)
                over.wait(0.1)

    context.addJobTag(tag)
    thread = threading.Thread(target=look, daemon=True)
    thread.start()
    try:
        yield
    except Exception as e:
        if wrong:
            raise wrong[0] from e
        raise
    finally:
        over.set()
        thread.join()
        context.removeJobTag(tag)
    if wrong:
        raise wrong[0]


def _tasks(spark: SparkSession, tag: str) -> tuple[int, int]:
    """Tasks done and in all of the stages that the tag's jobs run now."""
    context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    mine = set(context._jsc.sc().statusTracker().getJobIdsForTag(tag))
    done = total = 0
    for job in mine & set(tracker.getActiveJobsIds()):
        info = tracker.getJobInfo(job)
        for stage in map(tracker.getStageInfo, info.stageIds if info else ()):
            if stage is not None:
                done, total = done + stage.numCompletedTasks, total + stage.numTasks
    return done, total
