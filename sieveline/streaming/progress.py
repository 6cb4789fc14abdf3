"""Streams: progress counters, batched writes, queue draining, deduplication and bounded buffers.

Each stream runs with a checkpoint and ends by ``availableNow`` where it drains a source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.window import Window


def progress(df: DataFrame, group: str, order: str, failed: str) -> DataFrame:
    """Running counters of checked and failed rows within each job."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select(group, order, F.count("*").over(w).alias("checked"), F.sum(F.col(failed).cast("int")).over(w).alias("failed"))


def progress_frames(counters: DataFrame, group: str, order: str, every: int) -> DataFrame:
    """start, each ``every``-th progress and done, as event frames in order."""
    w = Window.partitionBy(group).orderBy("checked")
    last = F.lead("checked").over(w).isNull()
    kinds = F.array_compact(F.array(F.when(F.col("checked") == 1, F.lit("start")), F.when(F.col("checked") % every == 0, F.lit("progress")), F.when(last, F.lit("done"))))
    return counters.withColumn("_k", kinds).select(group, order, F.explode("_k").alias("type"), "checked", "failed").withColumn("frame", F.concat(F.lit("data: "), F.to_json(F.struct("type", "checked", "failed")), F.lit("\n\n")))


def running_counts(stream: DataFrame, group: str, failed: str) -> DataFrame:
    """The same counters over a stream, held as state of each job: an aggregation whose rows are added up before they are shuffled."""
    bad = F.coalesce(F.col(failed).cast("boolean"), F.lit(False)).cast("long")
    return stream.groupBy(group).agg(F.count("*").alias("checked"), F.sum(bad).alias("failed"))


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Work off what is there now in batches; a restart goes on after the last finished batch."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unique_stream(stream: DataFrame, key: str, time: str | None = None, within: str = "1 hour") -> DataFrame:
    """The first row of each key; with an event time the state is bounded."""
    return stream.dropDuplicates([key]) if time is None else stream.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def queue_done(jobs: DataFrame, staged: DataFrame) -> DataFrame:
    """id, complete of each job: discovery over and nothing pending or under way."""
    open_ = staged.groupBy("job_id").agg(F.count_if(F.col("status").isin("pending", "downloading")).alias("_open"))
    return jobs.join(open_, F.col("id") == F.col("job_id"), "left").select("id", (F.col("discovered") & (F.coalesce("_open", F.lit(0)) == 0)).alias("complete"))


def bounded_buffer(frames: DataFrame, session: str, at: str, sessions: int = 50, most: int = 2000) -> DataFrame:
    """The newest frames of the newest sessions."""
    newest = frames.groupBy(session).agg(F.max(at).alias("_last")).orderBy(F.desc("_last"), session).limit(sessions).select(session)
    rn = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(at)))
    return frames.join(F.broadcast(newest), session).withColumn("_rn", rn).where(F.col("_rn") <= most).drop("_rn")  # at most ``sessions`` rows


def resumable(categories: DataFrame, done: int, order: str = "pos") -> DataFrame:
    """Categories after the first ``done``."""
    return categories.where(F.col(order) >= done)


class ProgressEvents(StreamingQueryListener):
    """Collects start, progress and end of queries as (kind, rows)."""

    def __init__(self):
        self.events: list[tuple[str, int]] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.events.append(("started", 0))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.events.append(("progress", event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.events.append(("idle", 0))

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.events.append(("terminated", 0))
