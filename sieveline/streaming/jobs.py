"""Jobs as streams: duplicate search, rejection in batches, a discovery queue with workers, and control of a running job.

Frames are rows (seq, frame) in order; a web layer sends them on. A queue's items are files that
discovery appends; workers are the tasks of a micro-batch. What a job has done lies in its
checkpoint and its tables, so pausing is stopping the query, and resuming starts it again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ranking import numbered, running_total
from ..operators.similarity import greedy_groups, parallel_map

#: Kinds of scraping events.
EVENTS = ("scrape_start", "scrape_page", "scrape_complete", "download_start", "download_progress", "download_success", "download_fail", "download_complete", "extract_file", "error")


def frame_of(*fields: Column) -> Column:
    """A server-sent event of the fields; null fields are left out."""
    return F.concat(F.lit("data: "), F.to_json(F.struct(*fields)), F.lit("\n\n"))


def duplicate_frames(hashes: DataFrame, key: str, name: str, value: str, threshold: int = 2, every: int = 5) -> DataFrame:
    """seq, frame of a duplicate search over (key, name, hash): starting, hashing at each ``every``-th and the last row by name, analyzing, complete.

    Rows without a hash count on the way and are in no group.
    """
    placed = numbered(hashes.select(key, name), name, "at", key)
    total = hashes.agg(F.count("*").alias("total"))
    groups = greedy_groups(hashes.where(F.col(value).isNotNull()), key, value, threshold, key)
    sizes = groups.groupBy("leader").agg(F.count("*").alias("n")).where("n > 1")
    found = sizes.agg(F.count("*").alias("total_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("total_duplicates"))
    says = lambda status: F.lit(status).alias("status")
    start = total.select(F.lit(0).cast("bigint").alias("seq"), frame_of(says("starting"), F.col("total")).alias("frame"))
    steps = placed.join(F.broadcast(total), F.lit(True)).where((F.col("at") % every == 0) | (F.col("at") == F.col("total")))  # one row
    hashing = steps.select(F.col("at").cast("bigint").alias("seq"), frame_of(says("hashing"), F.col(name).alias("name"), F.col("at").alias("current"), "total").alias("frame"))
    analyzing = total.select((F.col("total") + 1).alias("seq"), frame_of(says("analyzing")).alias("frame"))
    complete = total.join(F.broadcast(found), F.lit(True)).select((F.col("total") + 2).alias("seq"), frame_of(says("complete"), F.col("total_groups"), F.col("total_duplicates")).alias("frame"))  # one row each
    return start.union(hashing).union(analyzing).union(complete)


def rejection_frames(rows: DataFrame, order: str, failed: Column, batch: int = 500, every: int = 100) -> DataFrame:
    """seq, type, checked, failed, rejected: progress where a batch of failed rows is full and at every so many rows, then the end.

    ``rejected`` counts full batches on the way, and all failed rows at the end.
    """
    placed = numbered(rows.select(order, failed.cast("int").alias("_bad")), order, "checked")
    seen = running_total(placed, "checked", F.col("_bad"), "failed")
    steps = seen.where((F.col("_bad") == 1) & (F.col("failed") % batch == 0) | (F.col("checked") % every == 0))
    full = (F.floor(F.col("failed") / batch) * batch).cast("bigint")
    steps = steps.select(F.col("checked").cast("bigint").alias("seq"), F.lit("progress").alias("type"), F.col("checked").cast("bigint").alias("checked"), F.col("failed").cast("bigint").alias("failed"), full.alias("rejected"))
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(failed.cast("bigint")), F.lit(0)).alias("bad"))
    return steps.union(total.select(F.col("n") + 1, F.lit("done"), F.col("n"), F.col("bad"), F.col("bad")))


def reject_in_batches(stream: DataFrame, failed: Column, removal: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Removals of the failed rows, appended batch by batch; a batch is written once, as its number names its folder."""

    def write(batch: DataFrame, number: int) -> None:
        removal(batch.where(failed)).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_poll(stream: DataFrame, order: str, most: int, sink: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Gives ``sink`` the newest ``most`` rows of each batch, oldest first."""
    newest = lambda batch, number: sink(batch.orderBy(F.desc(order)).limit(most).orderBy(order))
    return stream.writeStream.foreachBatch(newest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stroke_phases(df: DataFrame, variants: dict[str, Sequence[Sequence[int]]]) -> DataFrame:
    """glyph, step, phase, variant, score, n_strokes, done: the frames of finding each glyph's fewest strokes (glyph, mask, width)."""
    import pandas as pd

    from ..functions.glyphs import mask_of, minimal_strokes
    from ..session import ship

    ship(df.sparkSession)

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for f in frames:
            rows = [(g, step, phase, variant, float(score), len(strokes), phase == "complete") for g, m, w in f.itertuples(index=False) for step, (phase, variant, score, strokes) in enumerate(minimal_strokes(mask_of(m, w), variants))]
            yield pd.DataFrame(rows, columns=["glyph", "step", "phase", "variant", "score", "n_strokes", "done"])

    return df.select("glyph", "mask", "width").mapInPandas(run, f"glyph {df.schema['glyph'].dataType.simpleString()}, step int, phase string, variant string, score double, n_strokes int, done boolean")


def work_off(items: DataFrame, key: str, function: Callable, columns: Sequence[str], workers: int | None = None) -> DataFrame:
    """key, status, file_path, error of each item: the executors' tasks are the workers, and a failing item is reported in its row."""
    rows = items.repartition(workers, key) if workers else items
    done = parallel_map(rows, key, function, columns)
    return done.select(F.col("key").alias(key), F.when(F.col("success"), "completed").otherwise("failed").alias("status"), F.col("value").alias("file_path"), "error")


def claimed_progress(results: DataFrame, key: str, every: int = 50) -> DataFrame:
    """The log lines of workers: at each ``every``-th completed item, in order of the key."""
    good = numbered(results.where("status = 'completed'").select(key), key, "downloaded")
    return good.where(F.col("downloaded") % every == 0).select("downloaded")


@dataclass
class DownloadQueue:
    """One discovery folder, workers on what it holds, and the control of the job.

    ``discovered`` is a folder of JSON lines (``schema``); results are appended below ``results``,
    a folder a batch. A stopped job goes on after its last finished batch.
    """

    spark: SparkSession
    discovered: str
    schema: str
    results: str
    checkpoint: str
    function: Callable
    key: str = "id"
    columns: Sequence[str] = ("url",)
    workers: int = 4
    files_a_batch: int = 100
    status: str = "new"
    log: list[tuple[str, str]] = field(default_factory=list)
    query: StreamingQuery | None = None

    def _note(self, status: str, message: str) -> None:
        self.status = status
        self.log.append((status, message))

    def start(self, files_a_batch: int | None = None) -> DownloadQueue:
        """Work off what is there; new files are for the next start. The number of files in a batch is kept when the job resumes."""
        self.files_a_batch = files_a_batch or self.files_a_batch
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files_a_batch).json(self.discovered)

        def batch(items: DataFrame, number: int) -> None:
            work_off(items.dropDuplicates([self.key]), self.key, self.function, self.columns, self.workers).write.mode("overwrite").parquet(f"{self.results.rstrip('/')}/batch={number}")

        self._note("downloading", "job started")
        self.query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        return self

    def wait(self, seconds: float | None = None) -> bool:
        """True once everything discovered is worked off."""
        done = self.query is not None and self.query.awaitTermination(seconds) is not False
        if done and self.status == "downloading":
            self._note("completed", "job complete")
        return done

    def _stop(self, status: str, message: str) -> bool:
        if self.query is None or self.status != "downloading":
            return False
        self.query.stop()
        self._note(status, message)
        return True

    def pause(self) -> bool:
        return self._stop("paused", "job paused by user")

    def cancel(self) -> bool:
        return self._stop("cancelled", "job cancelled by user")

    def resume(self) -> bool:
        """Only a paused job, or one whose driver went away, goes on."""
        if self.status not in ("paused", "new", "downloading") or self.query is not None and self.query.isActive:
            return False
        self.start()
        self.log.append(("info", "job resumed"))
        return True

    def done(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.results.rstrip('/')}/batch=*")


def scrape_categories(categories: Sequence[str], discover: Callable[[str], DataFrame], download: Callable[[DataFrame], DataFrame], known: DataFrame, key: str = "url", done: int = 0, cancelled: Callable[[], bool] = lambda: False) -> tuple[DataFrame | None, list[tuple[str, str, int]]]:
    """Results of all categories after the first ``done``, and (event, category, rows) on the way.

    A category at a time, as each has to leave out what those before it found; within one, the
    rows are spread over the executors. Errors of discovery are events and end the category alone.
    """
    from ..session import settled

    out, events, seen = None, [], known.select(key)
    for name in list(categories)[done:]:
        if cancelled():
            break
        events.append(("scrape_start", name, 0))
        try:
            new = settled(discover(name).dropDuplicates([key]).join(seen, key, "left_anti"), "discovered")
        except Exception as e:  # noqa: BLE001  an event, as for the category's other errors
            events.append(("error", f"{name}: {e}", 0))
            continue
        n = new.count()
        events.append(("scrape_complete", name, n))
        if cancelled():
            break
        if n:
            events.append(("download_start", name, n))
            got = settled(download(new), "downloaded")
            counts = {r["status"]: r["n"] for r in got.groupBy("status").agg(F.count("*").alias("n")).collect()}  # a row a status
            events += [("download_success", name, counts.get("completed", 0)), ("download_fail", name, counts.get("failed", 0)), ("download_complete", name, n)]
            out = got if out is None else out.unionByName(got)
            seen = seen.union(new.select(key))
    return out, events


class Adapters:
    """Sources by name: each a function without arguments to a frame of what it finds."""

    def __init__(self):
        self.known: dict[str, Callable[[], DataFrame]] = {}

    def add(self, name: str, find: Callable[[], DataFrame]) -> Adapters:
        self.known[name] = find
        return self

    def names(self) -> list[str]:
        return sorted(self.known)

    def run(self, names: Sequence[str], work: Callable[[DataFrame], int], spark: SparkSession) -> DataFrame:
        """source, n, status of working off each named source; one that is unknown or fails is reported and stops no other."""
        rows = []
        for name in names:
            try:
                rows.append((name, int(work(self.known[name]())), "done") if name in self.known else (name, 0, "no adapter"))
            except Exception as e:  # noqa: BLE001  reported
                rows.append((name, 0, f"failed: {e}"))
        return spark.createDataFrame(rows, "source string, n bigint, status string")


@dataclass
class PagedJob:
    """A job that reads paged listings category by category into a folder; it can stop after any batch and goes on at the next page.

    Where it is, the finished categories and the current page, is the offset in the query's checkpoint.
    """

    spark: SparkSession
    results: str
    checkpoint: str
    options: dict[str, str]

    def _query(self, **trigger) -> StreamingQuery:
        from ..sources.pages import register

        register(self.spark)
        stream = self.spark.readStream.format("paged-stream").options(**self.options).load()
        return stream.writeStream.format("parquet").option("path", self.results).option("checkpointLocation", self.checkpoint).trigger(**trigger).start()

    def step(self) -> bool:
        """Read the pages of one batch; false once there is nothing left."""
        query = self._query(availableNow=True)
        query.awaitTermination()
        return any(p.batchId >= 0 and p.sources[0].startOffset != p.sources[0].endOffset for p in query.recentProgress)

    def run(self, most: int | None = None) -> int:
        """Batches read: all that are left, or at most so many before the job pauses.

        What is left is read by one query, a batch after the other: a query costs seconds to start.
        """
        if most is None:
            before = self._batches()
            query = self._query(processingTime="0 seconds")
            try:
                query.processAllAvailable()
            finally:
                query.stop()
            return self._batches() - before
        n = 0
        while n < most and self.step():
            n += 1
        return n

    def _batches(self) -> int:
        """Batches that have been finished, by the numbers of the checkpoint's commits."""
        from ..sources.pages import names_below

        return 1 + max((int(n) for n in names_below(f"{self.checkpoint.rstrip('/')}/commits") if n.isdigit()), default=-1)

    def found(self) -> DataFrame:
        return self.spark.read.schema("category string, page int, url string").parquet(self.results)
