"""Near duplicates by 64-bit perceptual hashes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import settled, ship


def bands(threshold: int, bits: int = 64) -> tuple[list[tuple[int, int]], int]:
    """Spans of bits and a radius: two hashes within the threshold are within the radius in one of the spans.

    At most four spans, so that a span is wide enough to tell hashes apart.
    """
    n = min(threshold + 1, 4)
    cuts = [bits * i // n for i in range(n + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True)), threshold // n


def near_masks(width: int, radius: int) -> list[int]:
    """All patterns of at most ``radius`` bits out of ``width``."""
    return [sum(1 << i for i in chosen) for r in range(radius + 1) for chosen in combinations(range(width), r)]


def hash_classes(df: DataFrame, key: str, value: str) -> DataFrame:
    """h, first, copies: a row for each hash, however many rows have it."""
    return df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("h")).agg(F.min(key).alias("first"), F.count("*").alias("copies"))


def class_members(df: DataFrame, key: str, value: str) -> DataFrame:
    """member, first: the class of each row, known by its smallest key."""
    first = hash_classes(df, key, value).select("h", "first")
    return df.select(F.col(key).alias("member"), F.col(value).alias("h")).join(first, "h").select("member", "first")


def near_in_blocks(a: np.ndarray, b: np.ndarray, threshold: int, rows: int = 16, columns: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions in ``a`` and ``b`` and the distance of unsigned hashes that differ in at most ``threshold`` bits, some ten thousand pairs at once.

    A block of comparisons stays in a core's cache: half a megabyte, over and over again in the same arrays.
    """
    bits, counts = np.empty((rows, columns), np.uint64), np.empty((rows, columns), np.uint8)
    found, n = [], 0
    for at in range(0, len(a), rows):
        strip = a[at : at + rows, None]
        for start in range(0, len(b), columns):
            part = b[None, start : start + columns]
            x, apart = bits[: len(strip), : part.shape[1]], counts[: len(strip), : part.shape[1]]
            np.bitwise_count(np.bitwise_xor(strip, part, out=x), out=apart)
            near = np.flatnonzero(apart <= threshold)
            if len(near):
                i, j = np.divmod(near, part.shape[1])
                found.append((at + i, start + j, apart[i, j]))
                n += len(near)
        if found and (n >= 10000 or at + rows >= len(a)):
            yield tuple(np.concatenate(f) for f in zip(*found, strict=True))
            found, n = [], 0


def block_pairs(hashes: DataFrame, threshold: int, block: int = 16384, most: int = 2000) -> DataFrame:
    """ha, hb, distance of the distinct hashes ``h`` that differ in at most ``threshold`` bits, by comparing all pairs.

    Hashes are dealt to blocks of about ``block``; each pair of blocks is a group that one task compares, and
    a partition of its own (``most`` at most): they are small in bytes but not in work, so that Spark would join many
    of them into one task. A comparison takes about a nanosecond and nothing but true pairs leaves a task.
    """
    n = max(1, -(-hashes.count() // block))
    own = hashes.select("h", F.pmod(F.xxhash64("h"), F.lit(n)).cast("int").alias("own"))
    dealt = own.select("h", "own", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other")).select("h", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b["h"].to_numpy(), b["own"].to_numpy()) for b in batches]
        h, of = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        i, j = (k.as_py() for k in key)
        a, b = np.sort(h[of == i]), np.sort(h[of == j])
        for x, y, apart in near_in_blocks(a.view(np.uint64), b.view(np.uint64), threshold):
            if i == j:
                x, y, apart = x[keep := a[x] < b[y]], y[keep], apart[keep]
            if len(x):
                low, high = np.minimum(a[x], b[y]), np.maximum(a[x], b[y])
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(apart.astype(np.int32))], names=["ha", "hb", "distance"])

    return dealt.repartitionByRange(min(n * (n + 1) // 2, most), "i", "j").groupBy("i", "j").applyInArrow(run, "ha bigint, hb bigint, distance int")


def hamming_pairs(df: DataFrame, key: str, value: str, threshold: int, bits: int = 64) -> DataFrame:
    """a, b, distance of the classes of equal hashes (bigint, its low ``bits``) that differ in at most ``threshold`` bits.

    A class stands for all its copies by its smallest key, so a mass of copies costs one row; see
    :func:`class_members`. Two hashes within the threshold lie within a small radius in one span of
    bits: one side sends the patterns near its span, the other those nearer still, so that the two
    meet in an equi-join without a long list on either side. Where that radius is 2 or more, most pairs
    that meet are not near, as many as the square of the rows: they are compared in blocks instead.
    """
    one = hash_classes(df, key, value)
    spans, radius = bands(threshold, bits)
    if radius > 1:
        one = settled(one, "hashes")
        return _named(block_pairs(one, threshold), one)

    def keyed(reach: int, name: str) -> DataFrame:
        span = [F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(F.shiftleft(F.col("h"), 64 - high), 64 - (high - low)).alias("bits"), F.lit(high - low).alias("width")) for i, (low, high) in enumerate(spans)]
        rows = one.select(F.col("h").alias(name), F.explode(F.array(*span)).alias("k")).select(name, "k.*")
        masks = F.create_map(*[x for w in sorted({high - low for low, high in spans}) for x in (F.lit(w), F.array(*[F.lit(m).cast("bigint") for m in near_masks(w, reach)]))])
        return rows.select(name, "band", F.explode(F.transform(masks[F.col("width")], lambda m: F.col("bits").bitwiseXOR(m))).alias("bits"))

    apart = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb")))
    met = keyed(radius - radius // 2, "ha").join(keyed(radius // 2, "hb"), ["band", "bits"])
    near = met.where((F.col("ha") != F.col("hb")) & (apart <= threshold)).select(F.least("ha", "hb").alias("ha"), F.greatest("ha", "hb").alias("hb"), apart.alias("distance")).distinct()
    return _named(near, one)


def _named(near: DataFrame, one: DataFrame) -> DataFrame:
    """Pairs of hashes as pairs of their classes' first keys."""
    x, y = one.select(F.col("h").alias("ha"), F.col("first").alias("x")), one.select(F.col("h").alias("hb"), F.col("first").alias("y"))
    return near.join(x, "ha").join(y, "hb").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


def greedy_groups(df: DataFrame, key: str, value: str, threshold: int, order: str) -> DataFrame:
    """leader and member of each group: in order of appearance, each hash not taken yet takes all others within the threshold.

    Not transitive. Whether a hash leads depends on those before it within reach alone, so the
    greedy choice is settled in rounds over the candidate pairs: a hash leads once all earlier
    neighbours follow someone; it follows once an earlier neighbour leads.
    """
    df = settled(df.select(*dict.fromkeys((key, value, order))), "hashes")  # read four times, made once
    one = df.groupBy(F.col(value).alias("h")).agg(F.min(order).alias("at"))
    pairs = settled(hamming_pairs(one, "at", "h", threshold).select("a", "b"), "near-hashes")
    state = one.select("at", F.lit(None).cast("boolean").alias("leads"))
    while True:
        known = pairs.join(state.select(F.col("at").alias("a"), F.col("leads").alias("_l")), "a")
        earlier = known.groupBy("b").agg(F.bool_or(F.coalesce("_l", F.lit(False))).alias("taken"), F.bool_or(F.col("_l").isNull()).alias("open"))
        now = F.when(F.coalesce("taken", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True)
        state = settled(state.join(earlier, F.col("at") == F.col("b"), "left").select("at", F.coalesce("leads", now).alias("leads")), "leaders")
        if state.where("leads IS NULL").isEmpty():
            break
    leaders = state.where("leads").select(F.col("at").alias("a"))
    owner = pairs.join(leaders, "a").groupBy("b").agg(F.min("a").alias("lead"))
    placed = state.join(owner, F.col("at") == F.col("b"), "left").select("at", F.when(F.col("leads"), F.col("at")).otherwise(F.col("lead")).alias("lead"))
    of = one.join(placed, "at").select("h", "lead")
    names = df.groupBy(F.col(value).alias("h2")).agg(F.min_by(key, order).alias("leader"), F.min(order).alias("at2"))
    return df.select(F.col(key).alias("member"), F.col(value).alias("h")).join(of, "h").join(names.select("leader", F.col("at2").alias("lead")), "lead").select("leader", "member")


def keep_best(groups: DataFrame, scores: DataFrame, key: str, score: str, order: str) -> DataFrame:
    """leader, member, rank, keep: the best score of each group stays; a missing score is 0, ties by order."""
    own = scores.select(F.col(key).alias("member"), F.coalesce(score, F.lit(0.0)).alias("_score"), F.col(order).alias("_order"))
    rank = F.row_number().over(Window.partitionBy("leader").orderBy(F.desc(F.coalesce("_score", F.lit(0.0))), "_order"))
    return groups.join(own, "member", "left").select("leader", "member", rank.alias("rank")).withColumn("keep", F.col("rank") == 1)


def difference_hash(df: DataFrame, key: str, array: str, bits: int = 64) -> DataFrame:
    """key, h: a bit for each pair of neighbours in the array that rises."""
    rise = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.when(F.coalesce(F.get(F.col(array), i + 1) > F.get(F.col(array), i), F.lit(False)), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return df.select(key, F.aggregate(rise, F.lit(0).cast("bigint"), lambda s, b: s.bitwiseOR(b)).alias("h"))


def parallel_map(df: DataFrame, key: str, function, columns: Sequence[str]) -> DataFrame:
    """key, success, value, error of a Python function on each row: a failing row is reported, not raised."""
    ship(df.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, *args in f.itertuples(index=False):
                try:
                    rows.append((k, True, str(function(*args)), None))
                except Exception as e:  # noqa: BLE001  reported in the row
                    rows.append((k, False, None, str(e)))
            yield pd.DataFrame(rows, columns=["key", "success", "value", "error"])

    return df.select(key, *columns).mapInPandas(run, f"key {df.schema[key].dataType.simpleString()}, success boolean, value string, error string")
