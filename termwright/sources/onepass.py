"""A scan's one pass: utterances are cleaned and stored once and counted on the way, while progress is told."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .store import Batches, shared_folder

COUNTED = "termwright-utterances"  # the name of the counts in a stream's progress
Report = Callable[[int, int], None]


class Stored(NamedTuple):
    """Utterances read from where they were stored, what was counted on the way there, and the folder."""

    utterances: DataFrame
    metrics: dict[str, int]
    batches: Batches

    def drop(self) -> None:
        self.batches.drop("utterances")


def _counts() -> list[Column]:
    characters = F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0).cast("long"))
    return [F.count(F.lit(1)).alias("utterances"), characters.alias("characters")]


@contextmanager
def told(spark: SparkSession, report: Report, every: float = 1.0) -> Iterator[None]:
    """``report(done, tasks)`` every so many seconds, and once at the end: how many tasks of the stages that
    the block's jobs have begun so far, or skipped, are done. An error of ``report`` ends the reports and is
    raised after the block; the jobs are not disturbed. The thread's job group is put back."""
    sc, group, over, failed = spark.sparkContext, f"termwright-{uuid.uuid4().hex}", threading.Event(), []
    names = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")
    before = {k: sc.getLocalProperty(k) for k in names}
    tracker = sc.statusTracker()

    def say() -> None:
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
        stages = [tracker.getStageInfo(s) for s in {s for j in jobs if j for s in j.stageIds}]
        try:
            report(sum(s.numCompletedTasks for s in stages if s), sum(s.numTasks for s in stages if s))
        except Exception as error:  # noqa: BLE001  # the caller's own, raised below
            failed.append(error)
            over.set()

    def watch() -> None:
        while not over.wait(every):
            say()

    sc.setJobGroup(group, "termwright scan")
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield
    finally:
        over.set()
        watcher.join()
        for k, v in before.items():
            sc.setLocalProperty(k, v)
    if not failed:
        say()
    if failed:
        raise failed[0]


def stored(spark: SparkSession, utterances: DataFrame, report: Report | None = None) -> Stored:
    """Write ``utterances`` (project and text at least) once, in a new folder below ``spark.checkpoint.dir``.

    Utterances and characters are observed by that write itself; projects are counted from the one column of the
    stored table. Whatever reads the result doesn't parse or clean again, and lost executors don't cost that
    pass. Null texts count as utterances of no characters, a null project as none; an empty table counts 0.
    """
    seen = Observation()
    batches = Batches(spark, shared_folder(spark))
    if report is None:
        kept = batches.write("utterances", "rows", utterances.observe(seen, *_counts()))
    else:
        with told(spark, report):
            kept = batches.write("utterances", "rows", utterances.observe(seen, *_counts()))
    projects = kept.select("project").where("project IS NOT NULL").distinct().count()
    return Stored(kept, {"utterances": seen.get["utterances"], "characters": seen.get["characters"], "projects": projects}, batches)


def counted(stream: DataFrame) -> DataFrame:
    """A stream of utterances whose progress carries their counts, batch by batch, for ``Counts``."""
    return stream.observe(COUNTED, *_counts())


class Counts(StreamingQueryListener):
    """Tells ``report(utterances, characters)`` of each batch of ``counted`` streams: ``spark.streams.addListener(Counts(report))``."""

    def __init__(self, report: Report):
        self.report = report

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(COUNTED)
        if row is not None:
            self.report(row["utterances"], row["characters"])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
