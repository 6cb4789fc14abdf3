"""Windows, rankings, running values and run comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import settled


def _columns(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*_columns(order))))


def latest(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group in the order; Spark limits each group before the shuffle."""
    return ranked(df, group, order, "_rn").where(F.col("_rn") <= n).drop("_rn")


def best_of_group(df: DataFrame, group: str, key: str, order: Sequence[str | Column]) -> DataFrame:
    """Rank within the group and the key of its first row."""
    w = Window.partitionBy(group).orderBy(*_columns(order))
    return df.withColumn("rn", F.row_number().over(w)).withColumn("keeper", F.first(key).over(w))


def first_best(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """The row that first reaches the group's highest value; an aggregation, not a sort."""
    rest = [c for c in df.columns if c != group]
    best = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.max_by(F.struct(*rest), F.struct(F.col(value), -F.col(order))).alias("_best"))
    return best.select(group, *[F.col(f"_best.{c}").alias(c) for c in rest])


def improves(value: str, group: str, order: str) -> Column:
    """Whether a row is strictly above all before it."""
    before = F.max(value).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(F.col(value) > F.coalesce(before, F.lit(float("-inf"))), F.lit(False))


def difference(value: str, group: str, order: Sequence[str], first_zero: bool = True) -> Column:
    before = F.lag(value).over(Window.partitionBy(group).orderBy(*order))
    return F.col(value) - (F.coalesce(before, F.col(value)) if first_zero else before)


def prefix_sum(value: str, group: str, order: Sequence[str]) -> Column:
    return F.sum(value).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def moving_average(value: str, group: str, order: Sequence[str], before: int = 1, after: int = 1) -> Column:
    return F.avg(value).over(Window.partitionBy(group).orderBy(*order).rowsBetween(-before, after))


def padded_average(value: str, group: str, order: Sequence[str]) -> Column:
    """Moving average of three with the end values repeated."""
    w = Window.partitionBy(group).orderBy(*order)
    v = F.col(value)
    return (F.coalesce(F.lag(value).over(w), v) + v + F.coalesce(F.lead(value).over(w), v)) / 3


def second_difference(value: str, group: str, order: Sequence[str]) -> Column:
    w = Window.partitionBy(group).orderBy(*order)
    return F.lead(value).over(w) - 2 * F.col(value) + F.lag(value).over(w)


def changed(value: str, group: str, order: Sequence[str]) -> Column:
    """False where a row repeats the value before it."""
    return ~F.col(value).eqNullSafe(F.lag(value).over(Window.partitionBy(group).orderBy(*order))) | F.lag(F.lit(1)).over(Window.partitionBy(group).orderBy(*order)).isNull()


def smoothed(value: str, group: str, order: str, sigma: float, truncate: float = 4.0) -> Column:
    """Gaussian smoothing with the end values repeated; weights are constants of the plan."""
    radius = int(truncate * sigma + 0.5)
    weights = [2.718281828459045 ** (-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total, w = sum(weights), Window.partitionBy(group).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    out = F.lit(0.0)
    for k, weight in zip(range(-radius, radius + 1), weights, strict=True):
        at = F.col(value) if k == 0 else F.coalesce(F.lag(value, -k).over(w), first) if k < 0 else F.coalesce(F.lead(value, k).over(w), last)
        out = out + at * (weight / total)
    return out


def ranged(df: DataFrame, order: str, name: str = "_part", sample: int | None = None) -> DataFrame:
    """Adds the number of the range of ``order`` that a row is in, as many ranges as the session's shuffles have partitions.

    The bounds are values of a bounded sample by hash, fixed before use, so every use of the
    column agrees; equal values are in one range and nulls in the first.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = sample or max(4096, 32 * parts)
    got = sorted({r[0] for r in df.where(F.col(order).isNotNull()).select(order).orderBy(F.xxhash64(order), order).limit(sample).collect()})
    bounds = [got[len(got) * i // parts] for i in range(1, parts)] if len(got) > parts else got
    number = F.lit(0)
    for b in dict.fromkeys(bounds):
        number = number + F.when(F.col(order) >= F.lit(b), 1).otherwise(0)
    return df.withColumn(name, number)


def numbered(df: DataFrame, order: str, name: str, *ties: str) -> DataFrame:
    """Ranks from 1 in the order: ranks within ranges plus the sizes of the ranges before. No task sees all rows."""
    parts = ranged(df, order)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a range
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(order, *ties))
    return parts.withColumn("_rank", rank).join(F.broadcast(before), "_part").withColumn(name, F.col("_rank") + F.col("_before")).drop("_part", "_rank", "_before")  # a row a range


def every_kth(df: DataFrame, order: str, k: int) -> DataFrame:
    """Rows k, 2k, ... of the global order."""
    return numbered(df, order, "_at").where(F.col("_at") % k == 0).drop("_at")


def tail(df: DataFrame, order: str, n: int) -> DataFrame:
    """The newest ``n`` rows, oldest first."""
    return df.orderBy(F.desc(order)).limit(n).orderBy(order)


def compare_runs(old: DataFrame, new: DataFrame, key: str, value: str, digits: int | None = 3) -> DataFrame:
    """Full outer comparison; the delta only where both sides have a value."""
    a, b = old.select(F.col(key).alias("_a"), F.col(value).alias("old_score")), new.select(F.col(key).alias("_b"), F.col(value).alias("new_score"))
    delta = F.col("new_score") - F.col("old_score")
    return a.join(b, F.col("_a") == F.col("_b"), "full").select(F.coalesce("_a", "_b").alias(key), "old_score", "new_score", (F.round(delta, digits) if digits is not None else delta).alias("delta"))


def by_delta(compared: DataFrame, key: str) -> DataFrame:
    """Worst first; unknown deltas stand as 0."""
    return compared.orderBy(F.coalesce("delta", F.lit(0.0)), key)


def regressions(baseline: DataFrame, results: DataFrame, key: str, metrics: Sequence[str], threshold: float = 0.05, worse_up: Sequence[str] = ("overshoot",)) -> DataFrame:
    """key, metric, was, now, change of every metric that got worse by more than the threshold, and status changes away from ok.

    Metrics that the baseline lacks are skipped.
    """
    shared = [m for m in metrics if m in baseline.columns]
    a = baseline.select(F.col(key), F.col("status").alias("_was"), *[F.col(m).alias(f"_{m}") for m in shared])
    joined = results.join(a, key)
    ok = (F.col("status") == "ok") & (F.col("_was") == "ok")
    stacked = ", ".join(f"'{m}', cast(`_{m}` as double), cast(`{m}` as double), {'-1' if m in worse_up else '1'}" for m in shared)
    worse = joined.where(ok).select(key, F.expr(f"stack({len(shared)}, {stacked}) as (metric, was, now, sign)"))
    change = F.col("sign") * (F.col("was") - F.col("now"))
    out = worse.where(change > threshold).select(key, F.concat("metric", F.lit("_regression")).alias("metric"), "was", "now", F.round(change, 3).alias("change"))
    status = joined.where((F.col("status") != "ok") & (F.col("_was") == "ok")).select(key, F.lit("status_change").alias("metric"), F.lit(None).cast("double").alias("was"), F.lit(None).cast("double").alias("now"), F.lit(None).cast("double").alias("change"))
    return out.union(status)


def ranked_in_ranges(df: DataFrame, group: str, order: str, part: str, name: str) -> DataFrame:
    """Ranks from 1 in each group in the order, where ``part`` numbers the ranges of the order (see :func:`ranged`): no task sees all rows of a large group."""
    sizes = df.groupBy(group, part).agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))  # a row a range of each group
    rank = F.row_number().over(Window.partitionBy(group, part).orderBy(order))
    return df.withColumn("_rank", rank).join(sizes.select(group, part, F.coalesce(before, F.lit(0)).alias("_before")), [group, part]).withColumn(name, F.col("_rank") + F.col("_before")).drop("_rank", "_before")


def nearest_available(wanted: DataFrame, available: DataFrame, key: str, value: str, item: str, within: int = 5) -> DataFrame:
    """key, item, gap: each wish (key, value) with the closest item (item, value) within reach, none used twice, earlier wishes (by key) first.

    Ties go to the smaller value, then to the smaller item. Items of one value are thus taken in their
    order, and a wish only needs to know how many items a value has. The serial rule is settled in rounds
    of offers: every wish asks for the best value of its list, a value keeps as many of the earliest
    wishes as it has items, and who is turned away strikes the value off. As all values rank the wishes
    alike, no order of the rounds can end elsewhere. Wishes and values meet by blocks of values.
    """
    block = lambda c: F.floor(F.col(c) / (within + 1)).cast("long")
    asks = ranged(wanted.select(F.col(key).alias("_wish"), F.col(value).alias("_at")), "_wish").select("_wish", "_part", "_at", F.explode(F.array(*[block("_at") + i for i in (-1, 0, 1)])).alias("_block"))
    items = settled(ranged(available.where(F.col(value).isNotNull()).select(F.col(item).alias("_item"), F.col(value).alias("_has")).distinct(), "_item"), "items")
    have = settled(items.groupBy("_has").agg(F.count("*").alias("_room")).withColumn("_block", block("_has")), "values")
    near = asks.join(have, "_block").where(F.abs(F.col("_has") - F.col("_at")) <= within)
    open_ = settled(near.select("_wish", "_part", F.struct(F.abs(F.col("_has") - F.col("_at")).alias("gap"), F.col("_has").alias("has")).alias("_by")), "wishes")
    while True:
        best = open_.groupBy("_wish", "_part").agg(F.min("_by").alias("_by")).withColumn("_has", F.col("_by.has"))
        best = settled(ranked_in_ranges(best, "_has", "_wish", "_part", "_turn"), "asked")
        full = best.join(have.select("_has", "_room"), "_has").groupBy("_has").agg(F.max(F.when(F.col("_turn") == F.col("_room"), F.col("_wish"))).alias("_last"), F.max(F.col("_turn") - F.col("_room")).alias("_over"))
        full = settled(full.where(F.col("_over") >= 0), "full")
        if full.where("_over > 0").isEmpty():
            break
        # whoever comes after the last wish that a full value keeps can never have it, whether they have asked already or not
        open_ = open_.withColumn("_has", F.col("_by.has")).join(full.select("_has", "_last"), "_has", "left").where(F.col("_last").isNull() | (F.col("_wish") <= F.col("_last"))).select("_wish", "_part", "_by")
        open_ = settled(open_, "wishes")
    placed = ranked_in_ranges(items, "_has", "_item", "_part", "_turn").select("_has", "_turn", "_item")
    return best.join(placed, ["_has", "_turn"]).select(F.col("_wish").alias(key), F.col("_item").alias(item), F.col("_by.gap").alias("gap"))


def sample_others(df: DataFrame, group: str, key: str, n: int, seed: str = "0") -> DataFrame:
    """key, other: ``n`` rows of the same group for each row, itself excluded, in an order by hash; groups too small repeat theirs.

    Each row takes the ``n`` rows after its own place in the group's hashed order, round and
    round: no pairs are formed that are not kept.
    """
    w = Window.partitionBy(group).orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), key)
    placed = df.select(group, key, (F.row_number().over(w) - 1).alias("_at"), F.count("*").over(Window.partitionBy(group)).alias("_n")).where("_n > 1")
    wanted = placed.select(group, key, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_k"), "_at", "_n").withColumn("_to", (F.col("_at") + 1 + F.col("_k") % (F.col("_n") - 1)) % F.col("_n"))
    there = placed.select(group, F.col(key).alias("other"), F.col("_at").alias("_to"))
    return wanted.join(there, [group, "_to"]).select(key, "_k", "other")


def best_variant(df: DataFrame, group: str, variant: str, score: str, order: str, favoured: str) -> DataFrame:
    """The best variant of each group: the first of equals in the order, but the favoured one wins its ties."""
    rank = F.struct(F.col(score), (F.col(variant) == favoured).cast("int"), -F.col(order))
    return df.groupBy(group).agg(F.max_by(F.struct(variant, score), rank).alias("_b")).select(group, f"_b.{variant}", f"_b.{score}")


def elapsed(time: str, group: str, order: str) -> Column:
    """Seconds since the group's first row."""
    w = Window.partitionBy(group).orderBy(order)
    return F.unix_timestamp(time) - F.unix_timestamp(F.first(time).over(w))


def remaining(done: Column, total: Column, seconds: Column) -> Column:
    """Estimated seconds left at the rate so far; null before anything is done."""
    return F.try_divide(seconds * (total - done), done)


def running_total(df: DataFrame, order: str, value: Column, name: str, *ties: str) -> DataFrame:
    """Sum of a value over the rows up to each in the order: sums within ranges plus those of the ranges before. No task sees all rows."""
    parts = ranged(df.withColumn("_value", value), order)
    sums = parts.groupBy("_part").agg(F.sum("_value").alias("_sum"))
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a range
    within = F.sum("_value").over(Window.partitionBy("_part").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return parts.withColumn("_within", within).join(F.broadcast(before), "_part").withColumn(name, F.col("_within") + F.col("_before")).drop("_part", "_value", "_within", "_before")  # a row a range


def progress_of_logs(logs: DataFrame, session: str, time: str, message: str, pattern: str = r"step (\d+)/(\d+)") -> DataFrame:
    """session, lines, done, rate, eta by the first and last lines that tell a step: steps of this session alone, a second, and seconds left."""
    at, of = F.regexp_extract(message, pattern, 1), F.regexp_extract(message, pattern, 2)
    steps = logs.where(at != "").select(session, F.unix_micros(F.col(time).cast("timestamp")).alias("_t"), at.cast("bigint").alias("_at"), of.cast("bigint").alias("_of"))
    g = steps.groupBy(session).agg(F.count("*").alias("lines"), F.min_by("_at", "_t").alias("_first"), F.max_by("_at", "_t").alias("_last"), F.max_by("_of", "_t").alias("_total"), ((F.max("_t") - F.min("_t")) / 1e6).alias("_seconds"))
    done = F.col("_last") - F.col("_first")
    return g.select(session, "lines", done.alias("done"), F.try_divide(done, F.col("_seconds")).alias("rate"), F.try_divide((F.col("_total") - F.col("_last")) * F.col("_seconds"), done).alias("eta"))
