"""Mutations as functions of frames: each returns the table as it is afterwards.

Parquet tables are not updated in place; :func:`replace_table` writes the new state beside the
old and swaps it in.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import numbered


def _numbered(new: DataFrame, old: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """New rows with ids after the highest old one."""
    top = old.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    ranked = numbered(new.drop(key), order[0], "_nth", *order[1:])  # range by range: no task sees all new rows
    return ranked.join(F.broadcast(top), F.lit(True)).withColumn(key, (F.col("_nth") + F.col("_top")).cast("bigint")).drop("_top", "_nth")  # one row


def insert_or_ignore(table: DataFrame, new: DataFrame, unique: Sequence[str], key: str = "id") -> DataFrame:
    """Append the first of each new unique value that the table lacks."""
    w = Window.partitionBy(*unique).orderBy(*new.columns)
    fresh = new.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn").join(table.select(*unique), list(unique), "left_anti")
    return table.unionByName(_numbered(fresh, table, key, unique), allowMissingColumns=True)


def registered_ids(table: DataFrame, new: DataFrame, unique: str, key: str = "id") -> DataFrame:
    """The id of each new row's unique value."""
    return new.join(table.select(unique, key), unique)


def register_variant(table: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Insert what is new by (name, source), then by path."""
    fresh = new.join(table.select("name", "source"), ["name", "source"], "left_anti")
    return insert_or_ignore(table, fresh, ["file_path"], key)


def partial_upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows are made as needed; values that are not null overwrite, null ones keep what was there."""
    a, b = table.alias("a"), changes.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    cols = []
    for c in table.columns:
        if c in keys:
            cols.append(F.coalesce(f"a.{c}", f"b.{c}").alias(c))
        elif c in changes.columns:
            cols.append(F.coalesce(f"b.{c}", f"a.{c}").alias(c))
        else:
            cols.append(F.col(f"a.{c}").alias(c))
    return a.join(b, on, "full").select(*cols)


def insert_or_replace(table: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whole rows are replaced: columns that the new row lacks become null."""
    return table.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def save_by_precedence(table: DataFrame, key: Column, variant: str | None, points: int | None, strokes: str) -> DataFrame:
    """Save strokes and, of the extra values, the variant before the point count."""
    out = table.withColumn("strokes_raw", F.when(key, strokes).otherwise(F.col("strokes_raw")))
    if variant is not None:
        return out.withColumn("template_variant", F.when(key, variant).otherwise(F.col("template_variant")))
    if points is not None:
        return out.withColumn("point_count", F.when(key, points).otherwise(F.col("point_count")))
    return out


def append_best(current: DataFrame, runs: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Best value so far of each key: the first of the strictly highest, the current one included."""
    best = runs.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(F.col(value), F.struct(F.col(value), -F.col(order))).alias("_new"))
    return current.join(best, key, "left").withColumn(value, F.when(F.col("_new") > F.coalesce(F.col(value), F.lit(float("-inf"))), F.col("_new")).otherwise(F.col(value))).drop("_new")


def reject(removals: DataFrame, ids: DataFrame, reasons: DataFrame, code: str, details: Column | None = None, skip_existing: bool = True, add_reason: bool = False) -> DataFrame:
    """Append a removal of each id for a reason; unknown codes raise unless they are to be added (see :func:`with_reason`)."""
    found = reasons.where(F.col("code") == code).select("id").limit(1).collect()
    if not found:
        raise ValueError(f"unknown reason {code}")
    reason = found[0]["id"]
    said = (details if details is not None else F.lit(None)).cast("string")
    new = ids.select(F.col("asset_id").cast("bigint").alias("asset_id"), said.alias("details")).groupBy("asset_id").agg(F.min("details").alias("details"))
    if skip_existing:
        new = new.join(removals.where(F.col("reason_id") == reason).select("asset_id"), "asset_id", "left_anti")
    rows = new.withColumns({"reason_id": F.lit(reason).cast("bigint"), "removed_at": F.current_timestamp()})
    return removals.unionByName(_numbered(rows, removals, "id", ["asset_id"]), allowMissingColumns=True)


def with_reason(reasons: DataFrame, code: str, description: str) -> DataFrame:
    """The lookup with a code added if it is new."""
    return insert_or_ignore(reasons, reasons.sparkSession.createDataFrame([(None, code, description)], "id BIGINT, code STRING, description STRING"), ["code"])


def unreject(removals: DataFrame, reason: int, asset: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The table without the removals of a reason (of one asset), and the rows taken out."""
    gone = F.coalesce((F.col("reason_id") == reason) & (F.lit(True) if asset is None else F.col("asset_id") == asset), F.lit(False))
    return removals.where(~gone), removals.where(gone)


def removals_of_rules(rules: DataFrame, reasons: DataFrame, key: str) -> DataFrame:
    """A removal row for each failing rule (key, reason)."""
    return rules.join(reasons.where(F.col("code").isNotNull()).select(F.col("id").alias("reason_id"), "code"), F.col("reason") == F.col("code")).select(key, "reason_id")


def update(table: DataFrame, where: Column, values: Mapping[str, Column | str | int | float | None]) -> DataFrame:
    """Conditional update of any columns."""
    hit = F.coalesce(where, F.lit(False))
    lift = lambda v: v if isinstance(v, Column) else F.lit(v)
    return table.withColumns({c: F.when(hit, lift(v).cast(table.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def cancel(jobs: DataFrame, job: int) -> DataFrame:
    """Only pending or running jobs can be cancelled."""
    return update(jobs, (F.col("id") == job) & F.col("status").isin("pending", "running"), {"status": "cancelled"})


def transition(staged: DataFrame, item: int, status: str, file_path: str | None = None, error: str | None = None) -> DataFrame:
    """New status with the path if there is one, else with the error."""
    values: dict[str, str | None] = {"status": status}
    if file_path is not None:
        values["file_path"] = file_path
    elif error is not None:
        values["error_message"] = error
    return update(staged, F.col("id") == item, values)


def reset_stuck(staged: DataFrame, job: int | None = None) -> DataFrame:
    where = F.col("status") == "downloading"
    return update(staged, where if job is None else where & (F.col("job_id") == job), {"status": "pending"})


def claim(staged: DataFrame, n: int, order: str = "id") -> tuple[DataFrame, DataFrame]:
    """The next ``n`` pending rows, in order, and the table with them under way."""
    batch = staged.where("status = 'pending'").orderBy(order).limit(n).withColumn("status", F.lit("downloading"))
    return batch, staged.join(F.broadcast(batch.select(F.col("id").alias("_id"), F.lit(True).alias("_hit"))), F.col("id") == F.col("_id"), "left").withColumn("status", F.when(F.col("_hit"), "downloading").otherwise(F.col("status"))).drop("_id", "_hit")  # n rows


def clear_cache(characters: DataFrame, column: str, asset: int, char: str | None = None) -> tuple[DataFrame, int]:
    """A cached value of an asset, or of one of its characters, becomes null; and how many rows had one."""
    hit = (F.col("asset_id") == asset) & (F.lit(True) if char is None else F.col("char") == char)
    return update(characters, hit, {column: None}), characters.where(hit & F.col(column).isNotNull()).count()


def reject_by_first_reason(removals: DataFrame, items: Sequence[Mapping], reasons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A batch of rejections as a client sends it: the reason of the first item holds for all and is added if it is new; other keys become details."""
    if not items:
        return removals, reasons
    spark, code = removals.sparkSession, items[0].get("reason") or "manual"
    reasons = with_reason(reasons, code, code)
    rows = spark.createDataFrame([(i["asset_id"], json.dumps({k: v for k, v in i.items() if k not in ("asset_id", "reason")}) or None) for i in items], "asset_id BIGINT, details STRING").dropDuplicates(["asset_id"])
    return reject(removals, rows, reasons, code, F.col("details")), reasons


def reject_batch(removals: DataFrame, items: DataFrame, reasons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As :func:`reject_by_first_reason`, of a table of items (pos, asset_id, reason, details): of repeated assets the first item counts."""
    first = items.orderBy("pos").select("reason").first()
    if first is None:
        return removals, reasons
    code = first["reason"] or "manual"
    reasons = with_reason(reasons, code, code)
    rows = items.groupBy("asset_id").agg(F.min_by("details", "pos").alias("details"))
    return reject(removals, rows, reasons, code, F.col("details")), reasons


def stage(staged: DataFrame, found: DataFrame, job: int) -> DataFrame:
    """Append discovered items of a job as pending; those the job has by url are left out."""
    rows = found.withColumns({"job_id": F.lit(job).cast("bigint"), "status": F.lit("pending"), "created_at": F.current_timestamp()})
    own = staged.where(F.col("job_id") == job).select("url")
    return staged.unionByName(_numbered(rows.dropDuplicates(["url"]).join(own, "url", "left_anti"), staged, "id", ["url"]), allowMissingColumns=True)


def save_run(runs: DataFrame, asset: int, results: DataFrame, run_date: str) -> DataFrame:
    """Append a test run: counts and means of its rows (char, status, score, coverage, overshoot, stroke_count, topology), and the rows as JSON."""
    ok = F.col("status") == "ok"
    n = F.count_if(ok)
    means = [(F.coalesce(F.sum(F.when(ok, F.col(m))), F.lit(0.0)) / F.greatest(n, F.lit(1))).alias(f"avg_{m}") for m in ("score", "coverage", "overshoot", "stroke_count", "topology")]
    row = results.agg(F.count("*").cast("int").alias("chars_tested"), n.cast("int").alias("chars_ok"), *means, F.to_json(F.array_sort(F.collect_list(F.struct("char", "status", "score")))).alias("results_json"))  # the characters of one asset
    row = row.withColumns({"asset_id": F.lit(asset).cast("bigint"), "run_date": F.lit(run_date)})
    return runs.unionByName(_numbered(row, runs, "id", ["run_date"]), allowMissingColumns=True)


def touched(df: DataFrame, where: Column, values: Mapping[str, Column | str | int | float | None], stamp: str = "updated_at") -> DataFrame:
    """A conditional update that notes its time; of null values only the time is noted."""
    given = {c: v for c, v in values.items() if v is not None}
    return update(df, where, {**given, stamp: F.current_timestamp()})


def reset(tables: Mapping[str, DataFrame], kept: Sequence[str] = ("removal_reasons",)) -> dict[str, DataFrame]:
    """All tables empty but the lookups."""
    return {n: d if n in kept else cleared(d) for n, d in tables.items()}


@contextlib.contextmanager
def together(spark: SparkSession, folder: str) -> Iterator[dict[str, DataFrame]]:
    """Tables to be replaced, by name: what is put in becomes current with the end of the block, and nothing if it fails.

    All tables are written first; one file that names them is then put in place. One writer at a time.
    """
    new: dict[str, DataFrame] = {}
    yield new
    paths = versions(spark, folder)
    for name, df in new.items():
        paths[name] = f"{folder.rstrip('/')}/{name}/version-{uuid.uuid4().hex}"
        df.write.parquet(paths[name])
    spark.createDataFrame(list(paths.items()), "name string, path string").coalesce(1).write.mode("overwrite").json(f"{folder.rstrip('/')}/current")  # a row a table


def versions(spark: SparkSession, folder: str) -> dict[str, str]:
    """Where the current tables of a folder are; none before the first :func:`together` ends."""
    try:
        return {r["name"]: r["path"] for r in spark.read.schema("name string, path string").json(f"{folder.rstrip('/')}/current").collect()}
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return {}


def keep_newest(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(order)).limit(n)


def cleared(df: DataFrame) -> DataFrame:
    return df.limit(0)


def replace_table(spark: SparkSession, df: DataFrame, folder: str) -> str:
    """Write a new version below ``folder`` and point ``current`` at it; a failed write changes nothing."""
    version = f"{folder.rstrip('/')}/version-{uuid.uuid4().hex}"
    df.write.parquet(version)
    spark.createDataFrame([(version,)], "path string").coalesce(1).write.mode("overwrite").json(f"{folder.rstrip('/')}/current")
    return version


def current_table(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(spark.read.schema("path string").json(f"{folder.rstrip('/')}/current").first()["path"])
