"""Filters and joins over assets, their checks and their removals.

Three readings of "active" exist and are kept apart: not removed for one reason, not in any
removal (null-aware), and without a matching removal row. Joins to removals fan out, as an
asset may be removed more than once; :func:`rejected` takes ``distinct`` to undo that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_key(df: DataFrame, **keys) -> DataFrame:
    """Lookup by a simple or composite key; pushed down to the scan."""
    for name, value in keys.items():
        df = df.where(F.col(name) == value)
    return df


def with_value(df: DataFrame, column: str, *order: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).orderBy(*order)


def exists(df: DataFrame) -> bool:
    return not df.isEmpty()


def needing(items: DataFrame, checks: DataFrame, key: str, value: str) -> DataFrame:
    """Items whose check is missing or has a null: a left join and a null test, not an anti join."""
    c = checks.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    return items.join(c, F.col(key) == F.col("_key"), "left").where(F.col("_value").isNull()).drop("_key", "_value")


def passing(items: DataFrame, checks: DataFrame, key: str, gate: Column) -> DataFrame:
    """Inner join to the checks that pass the gate; nulls fail it."""
    return items.join(checks.where(gate).select(key), key)


def without(items: DataFrame, removed: DataFrame, key: str, removed_key: str | None = None) -> DataFrame:
    """Anti join: items without a matching removal; null keys on the right match nothing."""
    return items.join(removed.select(F.col(removed_key or key).alias("_key")).distinct(), F.col(key) == F.col("_key"), "left_anti")


def not_in(items: DataFrame, removed: DataFrame, key: str, removed_key: str) -> DataFrame:
    """SQL's NOT IN: empty as soon as the right side has a null, and never true for a null key unless the right side is empty.

    Written as an anti join on equality (which shuffles or broadcasts by size) and one scalar
    aggregate, as the null-aware form would only run as a broadcast.
    """
    right = removed.select(F.col(removed_key).alias("_key"))
    facts = right.agg(F.count("*").alias("_rows"), F.count_if(F.col("_key").isNull()).alias("_nulls"))
    kept = items.join(right.distinct(), F.col(key) == F.col("_key"), "left_anti")
    return kept.join(F.broadcast(facts), (F.col("_rows") == 0) | ((F.col("_nulls") == 0) & F.col(key).isNotNull())).select(*items.columns)  # one row


def eligible(items: DataFrame, checks: DataFrame, removed: DataFrame, key: str, good: Column) -> DataFrame:
    """Not removed, and either good or not judged yet (a null or missing check passes)."""
    kept = without(items, removed, key)
    c = checks.select(F.col(key).alias("_key"), good.alias("_good"))
    return kept.join(c, F.col(key) == F.col("_key"), "left").where(F.coalesce("_good", F.lit(True))).select(*items.columns)


def counted(items: DataFrame, details: DataFrame, key: str, detail_key: str, name: str, keep_zero: bool = True) -> DataFrame:
    """Items with the number of their details, aggregated before the join."""
    counts = details.groupBy(F.col(detail_key).alias("_key")).agg(F.count("*").alias("_n"))
    return items.join(counts, F.col(key) == F.col("_key"), "left" if keep_zero else "inner").withColumn(name, F.coalesce("_n", F.lit(0))).drop("_key", "_n")


def rejected(items: DataFrame, removals: DataFrame, key: str, removal_key: str, distinct: bool = False) -> DataFrame:
    """A row for each removal of an item, or one for each item."""
    r = removals.select(F.col(removal_key).alias("_key"))
    return items.join(r.distinct(), F.col(key) == F.col("_key"), "left_semi") if distinct else items.join(r, F.col(key) == F.col("_key")).drop("_key")


def lookup_counts(lookup: DataFrame, facts: DataFrame, key: str, fact_key: str, label: str) -> DataFrame:
    """All lookup rows with the number of facts, zero included; largest first, then by label."""
    n = facts.groupBy(F.col(fact_key).alias("_key")).agg(F.count("*").alias("_n"))
    return lookup.join(n, F.col(key) == F.col("_key"), "left").groupBy(F.col(label).alias("code")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("cnt")).orderBy(F.desc("cnt"), "code")


def as_dictionary(counts: DataFrame, key: str, value: str, name: str = "counts") -> DataFrame:
    """One row holding a map; for lookups of few keys."""
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(name))


def history(removals: DataFrame, items: DataFrame, reasons: DataFrame, on: Sequence[tuple[str, str]], reason: Column | None = None) -> DataFrame:
    """Removals with item and reason, filtered on the reason if asked."""
    out = removals.join(items, F.col(on[0][0]) == F.col(on[0][1])).join(reasons, F.col(on[1][0]) == F.col(on[1][1]))
    return out if reason is None else out.where(reason)


def by_parent(items: DataFrame, parents: DataFrame, column: str, parent: Column, value: str) -> DataFrame:
    """Items whose column equals the value of one parent row (a scalar subquery)."""
    one = parents.where(parent).agg(F.max(value).alias("_value"))
    return items.join(F.broadcast(one), F.col(column) == F.col("_value")).drop("_value")  # one row


def staged_anti(incoming: DataFrame, existing: Sequence[DataFrame], key: str) -> DataFrame:
    """Incoming rows whose key is in none of the key sets; repeats within the batch all stay."""
    keys = existing[0]
    for e in existing[1:]:
        keys = keys.unionByName(e)
    return incoming.join(keys.select(F.col(keys.columns[0]).alias("_key")).distinct(), F.col(key) == F.col("_key"), "left_anti")


def product(a: DataFrame, b: DataFrame, rows: int = 10_000) -> DataFrame:
    """Every combination with a small set (an alphabet, a list of styles), whose size is checked first."""
    if b.limit(rows + 1).count() > rows:
        raise ValueError(f"the right side has more than {rows} rows")
    return a.join(F.broadcast(b), F.lit(True))


def round_robin(writers: DataFrame, key: str, bases: DataFrame) -> DataFrame:
    """Each row with base number ``key mod n``; ``bases`` has a column ``slot`` numbered from 0."""
    n = bases.count()
    return writers.withColumn("slot", F.pmod(F.col(key), F.lit(n)).cast("int")).join(bases, "slot")


def containing(words: DataFrame, word: str, fonts: DataFrame, glyphs: str) -> DataFrame:
    """Words with the fonts that have all of their characters, by counting matches on characters instead of a cross join.

    Fonts of equal sets of characters are one class until the end, so that a character is not met once for each font that has it.
    """
    letters = words.select(F.col(word), F.explode(F.array_distinct(F.filter(F.split(word, ""), lambda c: c != ""))).alias("_c"))
    need = letters.groupBy(word).agg(F.count("*").alias("_need"))
    keys = [c for c in fonts.columns if c != glyphs]
    classed = fonts.select(*keys, F.array_sort(F.array_distinct(glyphs)).alias("_set"))
    have = classed.select("_set").distinct().select("_set", F.explode("_set").alias("_c"))
    got = letters.join(have, "_c").groupBy(word, "_set").agg(F.count("*").alias("_got")).join(need, word).where("_got = _need").select(word, "_set")
    return classed.join(got, "_set").select(word, *keys)


def active_in(df: DataFrame, column: str, states: Sequence[str], newest: str | None = None) -> DataFrame:
    out = df.where(F.col(column).isin(list(states)))
    return out.orderBy(F.desc(newest)).limit(1) if newest else out


def pending(df: DataFrame, job: int, category: str | None = None, limit: int | None = None, order: str = "id") -> DataFrame:
    """Optional predicates are added only when given; the limit is ordered."""
    out = df.where((F.col("job_id") == job) & (F.col("status") == "pending"))
    if category is not None:
        out = out.where(F.col("category") == category)
    return out.orderBy(order).limit(limit) if limit is not None else out


def clamp_limit(value: int | str | None, low: int = 1, high: int = 100, default: int = 10) -> int:
    """A requested page size; the default for what is no number or out of range."""
    try:
        n = int(value)
    except (TypeError, ValueError):
        return default
    return n if low <= n <= high else default


def by_file_name(results: DataFrame, assets: DataFrame, path: str = "file", key: str = "id", file_path: str = "file_path") -> DataFrame:
    """Results with the id of the asset whose file has the same name; results of unknown files are left out, equal names give the lowest id."""
    name = lambda c: F.regexp_extract(c, r"([^/]*)/*$", 1)
    of = assets.groupBy(name(F.col(file_path)).alias("_name")).agg(F.min(key).alias("asset_id"))
    return results.join(of, name(F.col(path)) == F.col("_name")).drop("_name")
