"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, small_batches

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table. Arrow batches stay small, as one text may be very long."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Make ready for Python workers: they get the package, and batches of few long texts.

    The session keeps the smaller batches, as frames run only after they have been returned.
    """
    ship(spark)
    small_batches(spark, rows)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for what is run inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextlib.contextmanager
def uncollected() -> Iterator[None]:
    """Without Python's search for cycles, which goes over large caches again and again; what is made inside has no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


_HELD: dict[str, dict] = {}


def release() -> None:
    """Give freed memory back to the machine: a Python worker outlives its task, and its neighbours need the room."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def held(operator: str) -> dict:
    """What this Python worker keeps for an operator from task to task; what it has kept for others goes."""
    others = [kept for name, kept in _HELD.items() if name != operator and kept]
    for kept in others:
        kept.clear()
    if others or operator not in _HELD:
        release()
    return _HELD.setdefault(operator, {})


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors see.

    Where the setting is missing on one machine (tests), a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="sieveline-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, label)
    df.write.option("compression", compression).option("parquet.block.size", str(32 << 20)).parquet(path)  # a writer holds a block
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def id_crc(c: Column) -> Column:
    """crc32 of the id written as text."""
    return F.crc32(c.cast("string").cast("binary"))


def shuffle_width(spark: SparkSession) -> int:
    """The number of partitions that the session plans for a shuffle."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def spread(df: DataFrame, each: int = 32 << 20, least: int | None = None) -> int:
    """Into how many groups to deal ``df``: ``least`` (twice the shuffle width), more where the planned size of the scan gives a group over ``each`` bytes."""
    planned = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = least or 2 * shuffle_width(df.sparkSession)
    return least if planned >= 1 << 60 else max(least, -(-planned // each))  # frames of unknown size plan for 2**63


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone: extra columns, clashing or not, play no part."""
    return df.select(*[F.col(f"`{n}`") for n in names])
