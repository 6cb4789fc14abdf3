"""Radius and nearest-neighbour joins on a grid, and graphs of pixels, within glyphs (any group column)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import settled, ship
from .ranking import latest, ranged

#: Places of a cell in which the search for nearest points begins.
CROWD = 64
#: Points of a group that is clustered as one row.
ALONE = 1000
OFFSETS = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]


def _cells(c: Column, r: float) -> Column:
    return F.floor(c / r).cast("int")


def around(df: DataFrame, r: float) -> DataFrame:
    """Each row once for its own and the eight neighbouring cells."""
    near = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in OFFSETS])
    return df.withColumn("_o", F.explode(near)).withColumns({"_cx": _cells(F.col("x"), r) + F.col("_o.dx"), "_cy": _cells(F.col("y"), r) + F.col("_o.dy")}).drop("_o")


def radius_join(points: DataFrame, cloud: DataFrame, r: float, group: str | None = None) -> DataFrame:
    """id, other, d2 of the points (id, x, y) and cloud points (other, x, y) within ``r``: an equi-join on cells, then the distance."""
    keys = [group] if group else []
    c = cloud.select(*keys, "other", F.col("x").alias("x2"), F.col("y").alias("y2"), _cells(F.col("x"), r).alias("_cx"), _cells(F.col("y"), r).alias("_cy"))
    d2 = (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2"))
    return around(points, r).join(c, [*keys, "_cx", "_cy"]).withColumn("d2", d2).where(F.col("d2") <= r * r).select(*keys, "id", "other", "d2")


def nearest(points: DataFrame, cloud: DataFrame, r: float, k: int = 1, group: str | None = None) -> DataFrame:
    """The ``k`` closest cloud points within ``r`` of each point; ties by id."""
    keys = [group] if group else []
    w = Window.partitionBy(*keys, "id").orderBy("d2", "other")
    return radius_join(points, cloud, r, group).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_all(points: DataFrame, cloud: DataFrame, start: float, k: int = 1) -> DataFrame:
    """id, other, d2, rank: the ``k`` closest cloud points of every point (fewer where the cloud has fewer), itself excluded by ``other``; ties by id.

    The radius begins at ``start`` and doubles for the points that have not found enough within it,
    until it spans all points; so crowded places are searched narrowly and no point is left out. Where a
    cell of ``start`` has many places the radius begins smaller. Of cloud points at one place the k + 1
    smallest ids alone can be among a point's closest.
    """
    size = cloud.count()
    ends = points.select("x", "y").union(cloud.select("x", "y")).agg(*[f(a) for a in ("x", "y") for f in (F.min, F.max)]).first()
    span = max([1e-9, *((ends[i + 1] - ends[i]) for i in (0, 2) if ends[i] is not None)]) * 1.5
    cloud = settled(latest(cloud.select("other", "x", "y"), ["x", "y"], ["other"], k + 1), "cloud")
    left, r, out = points, start, None
    while r > span * 1e-9 and (crowd := cloud.groupBy(_cells(F.col("x"), r), _cells(F.col("y"), r)).count().agg(F.max("count")).first()[0]) and crowd > CROWD * (k + 1):
        r /= 2
    while True:
        near = radius_join(left, cloud, r).where("id != other")
        w = Window.partitionBy("id").orderBy("d2", "other")
        near = settled(near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "nearest")
        full = near.where(F.col("rank") == min(k, max(1, size - 1))).select(F.col("id").alias("_full")).distinct()
        if r > span:
            return near if out is None else out.union(near)
        done = near.join(full, F.col("id") == F.col("_full"), "left_semi")
        out = done if out is None else out.union(done)
        left = settled(left.join(full, F.col("id") == F.col("_full"), "left_anti"), "unfound")
        if left.isEmpty():
            return out
        r *= 2


def nearest_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each row with the other row of closest value; ties, equal values among them, to the smaller key. Missing values come after all others.

    Rows of one value are a class, known by its two smallest keys: a row's nearest is the first key of its
    own class, if that is another row, or of a neighbouring class. Neighbours come from windows over ranges
    of the classes' values; across a border, from the last and first classes of the ranges around it (a row a range).
    """
    rows = df.select(key, value)
    classes = latest(rows.where(F.col(value).isNotNull()), [value], [key], 2).groupBy(value).agg(F.min(key).alias("_k"), F.max(key).alias("_k2"))
    pair = F.struct(F.col(value).alias("v"), F.col("_k").alias("k"))
    parts = ranged(settled(classes, "classes"), value)
    ends = parts.groupBy("_part").agg(F.min(pair).alias("_first"), F.max(pair).alias("_last"))
    order = Window.orderBy("_part")
    ends = ends.select("_part", F.lag("_last").over(order).alias("_before"), F.lead("_first").over(order).alias("_after"))
    w = Window.partitionBy("_part").orderBy(value)
    both = parts.withColumns({"below": F.lag(pair).over(w), "above": F.lead(pair).over(w)}).join(F.broadcast(ends), "_part")  # a row a range
    both = both.select(value, "_k", "_k2", F.coalesce("below", "_before").alias("below"), F.coalesce("above", "_after").alias("above"))
    lower, upper = F.abs(F.col(value) - F.col("below.v")), F.abs(F.col("above.v") - F.col(value))
    around_ = F.when(F.col("above").isNull() | (lower < upper) | ((lower == upper) & (F.col("below.k") < F.col("above.k"))), F.col("below.k")).otherwise(F.col("above.k"))
    beside = both.select(F.col(value).alias("_v"), "_k", "_k2", around_.alias("_around"))
    known = rows.join(beside, F.col(value) == F.col("_v"))
    known = known.select(key, F.when(F.col(key) != F.col("_k"), F.col("_k")).when(F.col("_k2") != F.col("_k"), F.col("_k2")).otherwise(F.col("_around")).alias("nearest"))
    missing = rows.where(F.col(value).isNull())
    lost = missing.agg(F.min(key).alias("_lost"))  # one row, as the next
    head = rows.orderBy(key).limit(2).agg(F.min(key).alias("_m"), F.max(key).alias("_m2"))
    known = known.crossJoin(F.broadcast(lost)).select(key, F.coalesce("nearest", "_lost").alias("nearest"))
    unknown = missing.crossJoin(F.broadcast(head)).select(key, F.when(F.col(key) != F.col("_m"), F.col("_m")).otherwise(F.col("_m2")).alias("nearest"))
    return known.union(unknown).where(F.col("nearest") != F.col(key))


def closest_point(pixels: DataFrame, x: float, y: float, group: str) -> DataFrame:
    d2 = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    return pixels.groupBy(group).agg(F.min_by(F.struct("x", "y"), F.struct(d2.alias("d"), "x", "y")).alias("p")).select(group, "p.x", "p.y")


def anchor_pixels(pixels: DataFrame, anchors: DataFrame, diagonal: float, depth: str = "depth", k: int = 50, group: str = "glyph") -> DataFrame:
    """For each of the anchors (nine as a rule) the pixel of best score (distance / diagonal - 0.3 * depth) among its k closest."""
    from .relational import product

    d = F.sqrt((F.col("x") - F.col("ax")) * (F.col("x") - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("y") - F.col("ay")))
    w = Window.partitionBy(group, "region").orderBy("d", "x", "y")
    near = product(pixels, anchors, 100).withColumn("d", d).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    return near.groupBy(group, "region").agg(F.min_by(F.struct("x", "y"), F.struct((F.col("d") / diagonal - 0.3 * F.col(depth)).alias("s"), "x", "y")).alias("p")).select(group, "region", "p.x", "p.y")


def inverted_index(df: DataFrame, key: str, item: str, block: int = 1000) -> DataFrame:
    """key, block, items: the sorted items (integers) of each key, in blocks of neighbouring items, so that no key's list need fit in a task."""
    return df.groupBy(key, F.floor(F.col(item) / block).cast("long").alias("block")).agg(F.sort_array(F.collect_list(item)).alias("items"))


def closest_ends(ends: DataFrame, group: str = "glyph") -> DataFrame:
    """For each glyph the closest pair of ends of different strokes (stroke, side, x, y); within a glyph these are few."""
    a = ends.select(group, *[F.col(c).alias(f"{c}1") for c in ("stroke", "side", "x", "y")])
    b = ends.select(group, *[F.col(c).alias(f"{c}2") for c in ("stroke", "side", "x", "y")])
    d = F.sqrt((F.col("x1") - F.col("x2")) * (F.col("x1") - F.col("x2")) + (F.col("y1") - F.col("y2")) * (F.col("y1") - F.col("y2")))
    return a.join(b, group).where("stroke1 < stroke2").groupBy(group).agg(F.min(F.struct(d.alias("d"), "stroke1", "stroke2", "side1", "side2")).alias("m")).select(group, "m.*")


def ray_hits(rays: DataFrame, segments: DataFrame, reach: float = 8.0, group: str = "glyph") -> DataFrame:
    """The first segment (of another stroke) that each ray (id, stroke, x, y, dx, dy) meets within ``reach``."""
    s = segments.select(group, F.col("stroke").alias("of"), "x1", "y1", "x2", "y2")
    ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    det = F.col("dx") * ey - F.col("dy") * ex
    t = F.try_divide((F.col("x1") - F.col("x")) * ey - (F.col("y1") - F.col("y")) * ex, det)
    u = F.try_divide((F.col("x1") - F.col("x")) * F.col("dy") - (F.col("y1") - F.col("y")) * F.col("dx"), det)
    hits = rays.join(s, group).where("stroke != of").withColumns({"t": t, "u": u}).where((F.col("t") > 0) & (F.col("t") < reach) & F.col("u").between(0, 1))
    return hits.groupBy(group, "id").agg(F.min(F.struct("t", "of")).alias("m")).select(group, "id", "m.t", "m.of")


def adjacency(pixels: DataFrame, group: str = "glyph") -> DataFrame:
    """Edges between 8-connected pixels."""
    near = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in OFFSETS if (dx, dy) != (0, 0)])
    moved = pixels.select(group, "x", "y", F.explode(near).alias("o")).select(group, "x", "y", (F.col("x") + F.col("o.dx")).alias("x2"), (F.col("y") + F.col("o.dy")).alias("y2"))
    return moved.join(pixels.select(group, F.col("x").alias("x2"), F.col("y").alias("y2")), [group, "x2", "y2"]).select(group, "x", "y", "x2", "y2")


def pixel_kinds(pixels: DataFrame, edges: DataFrame, group: str = "glyph") -> DataFrame:
    """Degree of each pixel; an end has one neighbour, a junction three or more."""
    n = edges.groupBy(group, "x", "y").agg(F.count("*").alias("degree"))
    d = F.coalesce("degree", F.lit(0))
    return pixels.select(group, "x", "y").join(n, [group, "x", "y"], "left").select(group, "x", "y", d.alias("degree"), F.when(d == 1, "end").when(d >= 3, "junction").otherwise("path").alias("kind"))


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root: components by propagating the smallest label with jumps; isolated nodes are their own."""
    both = settled(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    label = nodes.select("node", F.col("node").alias("root"))
    while True:
        low = both.join(label.select(F.col("node").alias("b"), F.col("root").alias("_r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("_r").alias("_low"))
        step = label.join(low, "node", "left").select("node", "root", F.least("root", F.coalesce("_low", "root")).alias("next"))
        jump = step.select(F.col("node").alias("_m"), F.col("next").alias("_e"))
        new = step.join(jump, F.col("next") == F.col("_m"), "left").select("node", "root", F.least("next", F.coalesce("_e", "next")).alias("next"))
        new = settled(new, "labels")
        done = new.where("next != root").isEmpty()
        label = new.select("node", F.col("next").alias("root"))
        if done:
            return label


def chained(xs: Sequence[np.ndarray], ys: Sequence[np.ndarray], r: float, pairs: int = 2_000_000) -> list[np.ndarray]:
    """For the points of each group the place of the first point that a chain of steps of at most ``r`` reaches; some ``pairs`` of points are compared at once."""
    sizes = np.array([len(x) for x in xs], np.int64)
    out, at = [], 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:] ** 2), pairs, "right")) + at)
        n = sizes[at:end]
        x, y = (np.concatenate([np.asarray(v, float) for v in part[at:end]]) for part in (xs, ys))
        begin = np.cumsum(n) - n
        each, first = np.repeat(n, n), np.repeat(begin, n)  # of each point: how many its group has, and where that begins
        i = np.repeat(np.arange(len(x)), each)
        j = np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first, each)
        near = ((x[i] - x[j]) * (x[i] - x[j]) + (y[i] - y[j]) * (y[i] - y[j]) <= r * r) | (i == j)
        i, j, root = i[near], j[near], np.arange(len(x))
        starts = np.searchsorted(i, root)
        while len(root):
            low = np.minimum.reduceat(root[j], starts)
            low = low[low]
            if (low == root).all():
                break
            root = low
        out += np.split(root - first, np.cumsum(n)[:-1])
        at = end
    return out


def radius_clusters(points: DataFrame, r: float, group: str = "glyph") -> DataFrame:
    """group, id, x, y, cluster of points (group, id, x, y): those that a chain of steps of at most ``r`` within a group joins; a cluster is named by its smallest id.

    A group of at most ``ALONE`` points is one row, and Python gets many of them at once. In larger groups
    neighbours are found by cells, and all those groups' components at once. Points without a group are near none.
    """
    ship(points.sparkSession)
    rows = points.select(group, "id", "x", "y")
    large = settled(rows.groupBy(group).agg(F.count("*").alias("_n")).where((F.col("_n") > ALONE) | F.col(group).isNull()).select(F.col(group).alias("_large")), "large")

    @F.pandas_udf("array<long>")
    def firsts(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series(chained(list(xs), list(ys), r), dtype=object)

    some = not large.isEmpty()
    few = rows.join(large, F.col(group).eqNullSafe(F.col("_large")), "left_anti") if some else rows
    each = few.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("id", "x", "y"))).alias("_p"))
    axis = lambda a: F.transform("_p", lambda p: p[a].cast("double"))
    named = each.select(group, "_p", firsts(axis("x"), axis("y")).alias("_f")).select(group, "_p", F.explode(F.arrays_zip(F.col("_p").alias("p"), F.col("_f").alias("f"))).alias("_z"))
    small = named.select(group, "_z.p.id", "_z.p.x", "_z.p.y", F.get("_p", F.col("_z.f").cast("int"))["id"].alias("cluster"))
    if not some:
        return small
    return small.union(_clusters_by_cells(rows.join(large, F.col(group).eqNullSafe(F.col("_large")), "left_semi"), r, group))


def _clusters_by_cells(points: DataFrame, r: float, group: str) -> DataFrame:
    named = points.withColumn("node", F.struct(group, "id"))
    near = radius_join(named.select(group, "id", "x", "y"), named.select(group, F.col("id").alias("other"), "x", "y"), r, group).where("id < other")
    edges = near.select(F.struct(group, F.col("id")).alias("a"), F.struct(F.col(group), F.col("other").alias("id")).alias("b"))
    label = connected(named.select("node"), edges)
    return named.join(label, "node").select(group, "id", "x", "y", F.col("root.id").alias("cluster"))


def cluster_centroids(members: DataFrame, cluster: str) -> DataFrame:
    return members.groupBy(cluster).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("size"))


def ends_to_clusters(ends: DataFrame, members: DataFrame, group: str = "glyph") -> DataFrame:
    """Cluster of each end: that of a member pixel at most one away; the lowest number wins."""
    m = members.select(group, F.col("x").cast("int").alias("_cx"), F.col("y").cast("int").alias("_cy"), "cluster")
    return around(ends, 1.0).join(m, [group, "_cx", "_cy"], "left").groupBy(group, "id").agg(F.min("cluster").alias("cluster"))


def loops(start_cluster: Column, end_cluster: Column) -> Column:
    """Whether both ends of a stroke are at one junction."""
    return F.coalesce(start_cluster == end_cluster, F.lit(False))


def junction_index(segments: DataFrame, group: str = "glyph") -> DataFrame:
    """junction -> segments that touch it; -1 is no junction."""
    # a junction has as many segments as meet there
    return segments.select(group, "segment", F.explode(F.array_distinct(F.array("start", "end"))).alias("junction")).where("junction >= 0").groupBy(group, "junction").agg(F.array_sort(F.collect_list("segment")).alias("segments"))


def best_chain(chains: DataFrame, group: str = "glyph") -> DataFrame:
    """The chain whose ends are closest to the targets (tx1, ty1), (tx2, ty2) in either orientation."""
    d = lambda a, b, c, e: F.sqrt((F.col(a) - F.col(c)) * (F.col(a) - F.col(c)) + (F.col(b) - F.col(e)) * (F.col(b) - F.col(e)))
    straight = d("x1", "y1", "tx1", "ty1") + d("x2", "y2", "tx2", "ty2")
    flipped = d("x1", "y1", "tx2", "ty2") + d("x2", "y2", "tx1", "ty1")
    return chains.groupBy(group).agg(F.min(F.struct(F.least(straight, flipped).alias("cost"), F.col("chain"), (flipped < straight).alias("flip"))).alias("m")).select(group, "m.*")
