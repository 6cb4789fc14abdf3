"""Strokes of a template drawn through the corners of a glyph.

Which pixel of a glyph's outline is a corner is said by rules: the nearest to a place of the box, the
rightmost or leftmost in a range of rows, the top. Places and ranges are expressions of the glyph's
box and of what its rows show (waist, gap); the rules of a glyph meet its outline where both are, in the
glyph's row, and the smallest (level, key) wins. Ties go to the upper, then to the left pixel.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import glyphs as Y
from ..functions.points import from_pairs, length, steps, total
from ..functions.templates import CAPITALS
from ..session import grown

#: The places of the nine corners in a box.
PLACES = {"TL": ("x0", "y0"), "TC": ("x0 + w // 2", "y0"), "TR": ("x1", "y0"), "ML": ("x0", "y0 + h // 2"), "MC": ("x0 + w // 2", "y0 + h // 2"), "MR": ("x1", "y0 + h // 2"), "BL": ("x0", "y1"), "BC": ("x0 + w // 2", "y1"), "BR": ("x1", "y1")}
#: Of the letters whose corners are not simply the nearest to their places: corner, rule, rows from and to (or a place), and the place to fall back on.
_STEM = [("TL", "near"), ("BL", "near")]
_BOWL = [*_STEM, ("TR", "right", "y0", "y0 + h // 3"), ("ML", "place", "waist_x", "waist"), ("MR", "right", "y0 + h // 4", "y0 + h // 2")]
_ARC = [("TR", "right", "y0", "y0 + h * 3 // 10"), ("BR", "right", "y1 - h * 3 // 10", "y1"), ("TL", "left", "y0 + h // 5", "y0 + h // 2"), ("BL", "left", "y0 + h // 2", "y1 - h // 5")]
_ARMS = [*_STEM, ("TR", "near"), ("ML", "place", "x0", "y0 + h // 2"), ("MR", "right", "y0 + h // 2 - h // 8", "y0 + h // 2 + h // 8")]
_BAR = [*_STEM, ("TR", "near"), ("BR", "near"), ("ML", "place", "x0", "y0 + h // 2"), ("MR", "place", "x1", "y0 + h // 2")]
CORNERS = {
    "A": [("TC", "top"), ("BL", "near"), ("BR", "near"), ("ML", "about", "gap_left", "gap_left_y"), ("MR", "about", "gap_right", "gap_right_y")],
    "B": [*_STEM, ("ML", "left", "waist - 3", "waist + 3"), ("TR_TOP", "right", "y0", "waist", "TR"), ("TR_BOT", "right", "waist", "y1", "BR")],
    "C": _ARC,
    "D": [*_STEM, ("TR", "right", "y0", "y0 + h // 3"), ("BR", "right", "y1 - h // 3", "y1")],
    "E": [*_ARMS, ("BR", "near")],
    "F": _ARMS,
    "G": [*_ARC, ("MR", "near"), ("MC", "near")],
    "H": _BAR,
    "K": _BAR,
    "P": _BOWL,
    "R": [*_BOWL, ("BR", "near")],
}
#: Strokes that have corners of their own, and strokes that are not refined.
STROKES = {**CAPITALS, "B": [["TL", "BL"], ["TL", "TR_TOP", "ML"], ["ML", "TR_BOT", "BL"]]}
AS_DRAWN = {"A": [2], "B": [1, 2]}


def rules_of(char: str) -> list[tuple]:
    """(corner, rule, from or x, to or y, x and y of the place to fall back on) of a letter."""
    given = CORNERS.get(char) or [(n, "near") for n in sorted({n for s in STROKES.get(char, []) for n in s})]
    out = []
    for corner, rule, *rest in given:
        place = PLACES[rest[2] if len(rest) > 2 else corner]
        low, high = rest[:2] if rest else ("0", "0")
        if rule in ("place", "about"):
            place = low, high
        out.append((corner, rule, low, high, *place))
    return out


def _spark(expression: str) -> Column:
    return F.expr(f"CAST({expression.replace('//', 'div')} AS int)")


def look(mask: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of rows with ink: number, first and last column, whether a step to the next pixel is over three; and the pixels, counted row by row, with one of four neighbours outside."""
    ys = np.flatnonzero(mask.any(axis=1))
    lines, width = mask[ys], mask.shape[1]
    at = np.where(lines, np.arange(width), -width)
    before = np.maximum.accumulate(at, axis=1)[:, :-1]
    gap = ((at[:, 1:] - before > 3) & (before >= 0)).any(axis=1)
    p = np.pad(mask, 1)
    rim = np.flatnonzero(mask & ~(p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]))
    return ys, lines.argmax(axis=1), width - 1 - lines[:, ::-1].argmax(axis=1), gap, rim


def features(glyphs: DataFrame, key: str = "glyph") -> DataFrame:
    """key, char, width, the box (x0, y0, x1, y1, w, h), waist and waist_x, the gap's ends and the outline of glyphs (key, char, mask, width) with ink."""

    @F.pandas_udf("y array<int>, left array<int>, right array<int>, gap array<boolean>, rim array<int>")
    def looked(mask: pd.Series, width: pd.Series) -> pd.DataFrame:
        seen = [look(Y.mask_of(m, w)) for m, w in zip(mask, width, strict=True)]
        return pd.DataFrame({name: pd.Series([s[k] for s in seen], dtype=object) for k, name in enumerate(("y", "left", "right", "gap", "rim"))})

    seen = glyphs.select(key, "char", "width", looked("mask", "width").alias("s")).where(F.size("s.y") > 0)
    seen = seen.withColumns({"rows": F.arrays_zip(*[F.col(f"s.{n}").alias(n) for n in ("y", "left", "right", "gap")]), "rim": F.col("s.rim")})
    seen = seen.withColumns({"x0": F.array_min("s.left"), "x1": F.array_max("s.right"), "y0": F.array_min("s.y"), "y1": F.array_max("s.y")})
    seen = seen.withColumns({"w": F.col("x1") - F.col("x0"), "h": F.col("y1") - F.col("y0")})
    within = lambda r, low, high: (r["y"] >= _spark(low)) & (r["y"] < _spark(high))
    waist = F.array_min(F.transform(F.filter("rows", lambda r: within(r, "y0 + h // 3", "y0 + 2 * h // 3")), lambda r: F.struct(r["right"].alias("right"), r["y"].alias("y"))))
    gaps = F.transform(F.filter("rows", lambda r: within(r, "y0 + h // 4", "y1 - h // 8") & r["gap"]), lambda r: r["y"])  # rows are in order
    seen = seen.withColumns({"narrow": waist, "gaps": gaps})
    middle = F.coalesce(F.get("gaps", F.floor(F.size("gaps") / 2).cast("int")), _spark("y0 + h * 3 // 5"))
    seen = seen.withColumns({"waist": F.coalesce(F.col("narrow.y"), _spark("y0 + h // 2")), "waist_x": F.coalesce(F.col("narrow.right"), F.col("x1") + 1), "level": middle})
    near = F.filter("rows", lambda r: (r["y"] >= F.greatest(F.col("y0"), F.col("level") - _spark("h // 8"))) & (r["y"] < F.least(F.col("y1"), F.col("level") + _spark("h // 8") + 1)))
    left = F.array_min(F.transform(near, lambda r: F.struct(r["left"].alias("x"), r["y"].alias("y"))))
    right = F.array_min(F.transform(near, lambda r: F.struct((-r["right"]).alias("x"), r["y"].alias("y"))))
    seen = seen.withColumns({"l": left, "r": right})
    ends = [F.coalesce("l.x", "x1").alias("gap_left"), F.coalesce("l.y", "level").alias("gap_left_y"), F.coalesce(-F.col("r.x"), F.col("x0")).alias("gap_right"), F.coalesce("r.y", "level").alias("gap_right_y")]
    return seen.select(key, "char", "width", "x0", "y0", "x1", "y1", "w", "h", "waist", "waist_x", *ends, "rim")


#: Fixed value: tasks that glyphs are dealt to, as a glyph is a small row with much work.
PARTS = 128


def corners(glyphs: DataFrame, key: str = "glyph") -> DataFrame:
    """key, char, corner, x, y of the corners of letters (key, char, mask, width)."""
    rule = lambda r: F.struct(F.lit(r[0]).alias("corner"), F.lit(r[1]).alias("rule"), *[_spark(e).alias(n) for e, n in zip(r[2:], ("low", "high", "px", "py"), strict=True)])
    by_char = many = None
    for char in sorted(STROKES):
        rules, is_char = rules_of(char), F.col("char") == char
        one = F.array(*[rule(r) for r in rules])
        by_char, many = (F.when(is_char, one), F.when(is_char, len(rules))) if by_char is None else (by_char.when(is_char, one), many.when(is_char, len(rules)))
    seen = features(glyphs.select(key, "char", "mask", "width").repartition(PARTS, key), key)
    asked = seen.select(key, "char", "width", "rim", by_char.alias("rules"), F.greatest(F.lit(5), _spark("h // 8")).alias("reach"), many.alias("many"))
    # numbers are exploded, not the rules: Spark asks for an exploded array to have members, by a filter in which all that the rules are made of is written out
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), many - 1)).alias("k")).select(key, "char", "width", "reach", F.get("rules", "k").alias("r"), "rim")
    asked = asked.select(key, "char", "width", "reach", "r.*", "rim")
    met = asked.select(key, "char", "corner", "rule", "low", "high", "px", "py", "reach", "width", F.explode("rim").alias("i"))
    met = met.withColumns({"x": F.col("i") % F.greatest(F.lit(1), "width"), "y": F.expr("CAST(i div greatest(1, width) AS int)")})
    x, y = F.col("x"), F.col("y")
    far = (x - F.col("px")) * (x - F.col("px")) + (y - F.col("py")) * (y - F.col("py"))
    inside = y.between(F.col("low"), F.col("high"))
    first = F.when(F.col("rule") == "top", y).when((F.col("rule") == "right") & inside, -x).when((F.col("rule") == "left") & inside, x).when((F.col("rule") == "about") & (F.abs(y - F.col("py")) <= F.col("reach")), far)
    met = met.withColumns({"first": first, "far": far})
    # (level, key, y, x) is one number, as y and x are the place: a number is compared and grouped far faster than a struct
    level = F.when(F.col("first").isNull(), 1 << 62).otherwise(0)
    by = level + (F.coalesce("first", "far").cast("long") + 65536) * (1 << 32) + F.col("i")
    best = met.groupBy(key, "char", "corner", "width").agg(F.min(by).alias("by"))
    i = F.expr("CAST(by % 4294967296 AS int)")
    return best.select(key, "char", "corner", (i % F.greatest(F.lit(1), "width")).alias("x"), F.floor(i / F.greatest(F.lit(1), "width")).cast("int").alias("y"))


def drawn(places: Column, n: int = 60) -> Column:
    """Points on the lines between places: of ``n`` each line gets its share by length, two at least; and the last place."""
    whole = total(F.transform(steps(places), length))

    def line(a: Column, k: Column) -> Column:
        b = F.get(places, k + 1)
        share = F.greatest(F.lit(2), F.floor(n * F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])) / whole).cast("int"))
        return F.transform(F.sequence(F.lit(0), share - 1), lambda j: F.struct((a["x"] + j / share * (b["x"] - a["x"])).alias("x"), (a["y"] + j / share * (b["y"] - a["y"])).alias("y")))

    lines = F.flatten(F.transform(F.slice(places, F.lit(1), F.size(places) - 1), line))
    return F.when((F.size(places) < 2) | (whole == 0), places).otherwise(F.concat(lines, F.slice(places, F.size(places), F.lit(1))))


def _chances(cells: np.ndarray, owner: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """For places x, y and their glyphs: the edge pixels that may be nearest to a point which rounds to the place, in order, filled up with infinity."""
    d = np.sqrt(((edge[owner] - cells[:, None]) ** 2).sum(axis=2))
    keep = d <= d.min(axis=1, keepdims=True) + 1.4143  # twice the way to a place's corner, which is the root of 1/2
    row, at = np.nonzero(keep)
    count = keep.sum(axis=1)
    out = np.full((len(cells), count.max(), 2), np.inf)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)] = edge[owner[row], at]
    return out


class _Nearest:
    """The pixel of its mask that is nearest to a point outside it, the upper and then the left one of several, for many points and masks at once.

    Which pixels of an edge come into question is found once for each place that points round to.
    """

    def __init__(self, masks: Sequence[np.ndarray]):
        shapes = np.array([m.shape for m in masks], np.int64)
        self.height, self.width = shapes.T
        self.first = np.cumsum(self.height * self.width) - self.height * self.width
        self.ink = np.concatenate([m.ravel() for m in masks])
        self.known, self.table = np.full(len(self.ink), -1, np.int64), np.empty((0, 1, 2))
        edges = [self._edge(m) for m in masks]
        self.edge = np.full((len(masks), max(map(len, edges)), 2), np.inf)
        for k, e in enumerate(edges):
            self.edge[k, : len(e)] = e

    @staticmethod
    def _edge(mask: np.ndarray) -> np.ndarray:
        """x, y of the pixels with one of eight neighbours outside: of others a neighbour is nearer to any point outside."""
        p = np.pad(mask, 1)
        rows = p[:-2] & p[1:-1] & p[2:]
        ys, xs = np.nonzero(mask & ~(rows[:, :-2] & rows[:, 1:-1] & rows[:, 2:]))
        return np.stack([xs, ys], axis=1).astype(float)

    def _within(self, at: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return (at >= 0).all(axis=1) & (at[:, 0] < self.width[owner]) & (at[:, 1] < self.height[owner])

    def outside(self, p: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The numbers of the points that are not on their mask."""
        at = np.rint(p).astype(np.int64)
        on = self._within(at, owner)
        on[on] = self.ink[(self.first[owner] + at[:, 1] * self.width[owner] + at[:, 0])[on]]
        return np.flatnonzero(~on)

    def of(self, p: np.ndarray, owner: np.ndarray) -> np.ndarray:
        out, at = np.empty_like(p), np.rint(p).astype(np.int64)
        within = self._within(at, owner)
        for i in np.flatnonzero(~within):
            e = self.edge[owner[i]]
            out[i] = e[((e - p[i]) ** 2).sum(axis=1).argmin()]
        which = np.flatnonzero(within)
        if not len(which):
            return out
        p, owner, at = p[which], owner[which], at[which]
        cell = self.first[owner] + at[:, 1] * self.width[owner] + at[:, 0]
        new = np.flatnonzero(self.known[cell] < 0)
        if len(new):
            new = new[np.unique(cell[new], return_index=True)[1]]
            some = max(1, 1_000_000 // self.edge.shape[1])
            for k in range(0, len(new), some):
                n = new[k : k + some]
                found = _chances(at[n].astype(float), owner[n], self.edge)
                width = max(self.table.shape[1], found.shape[1])
                wide = lambda t, width=width: np.pad(t, ((0, 0), (0, width - t.shape[1]), (0, 0)), constant_values=np.inf)
                self.known[cell[n]] = np.arange(len(self.table), len(self.table) + len(n))
                self.table = np.concatenate([wide(self.table), wide(found)])
        near = self.table[self.known[cell]]
        x, y = near[:, :, 0] - p[:, :1], near[:, :, 1] - p[:, 1:]
        out[which] = near[np.arange(len(p)), (x * x + y * y).argmin(axis=1)]
        return out


def refined_together(points: Sequence[np.ndarray], masks: Sequence[np.ndarray], rounds: int = 100) -> list[np.ndarray]:
    """Points of many strokes pulled into their glyphs: those outside go to its nearest pixel and all are smoothed, until none of a stroke is outside."""
    out = list(points)
    live = [k for k, (p, m) in enumerate(zip(points, masks, strict=True)) if len(p) and m.any()]
    if not live:
        return out
    distinct: dict[tuple, int] = {}
    place = [distinct.setdefault((masks[k].shape, masks[k].tobytes()), len(distinct)) for k in live]
    first = {n: masks[k] for k, n in reversed(list(zip(live, place, strict=True)))}
    nearest = _Nearest([first[n] for n in range(len(distinct))])
    stroke = np.repeat(live, [len(points[k]) for k in live])
    owner = np.repeat(place, [len(points[k]) for k in live])
    p = np.concatenate([points[k] for k in live]).astype(float)

    def finish(p: np.ndarray, stroke: np.ndarray) -> None:
        cut = np.flatnonzero(np.diff(stroke)) + 1
        for k, q in zip(stroke[np.concatenate([[0], cut])], np.split(p, cut), strict=True):
            out[k] = q

    for _ in range(rounds):
        off = nearest.outside(p, owner)
        going = np.zeros(len(points), bool)
        going[stroke[off]] = True
        stay = going[stroke]
        if not stay.all():
            finish(p[~stay], stroke[~stay])
            if not stay.any():
                return out
            moved = np.cumsum(stay) - 1
            off, p, stroke, owner = moved[off], p[stay], stroke[stay], owner[stay]
        p[off] = nearest.of(p[off], owner[off])
        inner = np.flatnonzero((stroke[:-2] == stroke[1:-1]) & (stroke[1:-1] == stroke[2:])) + 1
        smooth = 0.2 * p[inner - 1] + 0.6 * p[inner] + 0.2 * p[inner + 1]
        p[inner] = smooth
    off = nearest.outside(p, owner)
    if len(off):
        p[off] = nearest.of(p[off], owner[off])
    finish(p, stroke)
    return out


def refined(points: np.ndarray, mask: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Points of one stroke pulled into its glyph."""
    return refined_together([points], [mask], rounds)[0]


def _shares(masks: Sequence[np.ndarray], most: int = 1_000_000) -> Iterator[slice]:
    """Slices of masks with so many places at most, or of a single mask."""
    begin = held = 0
    for k, m in enumerate(masks):
        if held + m.size > most and k > begin:
            yield slice(begin, k)
            begin, held = k, 0
        held += m.size
    if len(masks):
        yield slice(begin, len(masks))


def morphed(glyphs: DataFrame, key: str = "glyph", n: int = 60, keep: Sequence[str] = ()) -> DataFrame:
    """key, stroke, points of the template's strokes through the corners of glyphs (key, char, mask, width), refined to lie within the glyph; and columns to keep."""

    @F.pandas_udf("array<double>")
    def fitted(mask: pd.Series, width: pd.Series, points: pd.Series) -> pd.Series:
        masks = [Y.mask_of(m, w) for m, w in zip(mask, width, strict=True)]
        strokes = [np.asarray(p, float).reshape(-1, 2) for p in points]
        return pd.Series([p.ravel() for s in _shares(masks) for p in refined_together(strokes[s], masks[s])], dtype=object)

    place = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    at = corners(glyphs, key).groupBy(key, "char").agg(F.map_from_entries(F.collect_list(F.struct("corner", place))).alias("at"))  # a letter's corners
    rest = glyphs.select(key, "mask", "width", *[k for k in keep if k not in (key, "char", "mask", "width")])
    at = at.repartition(PARTS, key).join(grown(rest.repartition(PARTS, key)), key)
    templates = glyphs.sparkSession.createDataFrame([(c, k, s, k not in AS_DRAWN.get(c, [])) for c, strokes in STROKES.items() for k, s in enumerate(strokes)], "char string, stroke int, names array<string>, refine boolean")
    rows = at.join(F.broadcast(templates), "char")  # a few strokes a letter, made by the driver
    rows = rows.withColumn("places", F.filter(F.transform("names", lambda name: F.try_element_at("at", name)), lambda p: p.isNotNull())).where(F.size("places") > 1)
    rows = rows.withColumn("points", drawn(F.col("places"), n))
    pulled = fitted("mask", "width", F.flatten(F.transform("points", lambda q: F.array(q["x"], q["y"]))))
    rows = rows.withColumn("pulled", pulled)
    return rows.select(key, *keep, "stroke", F.when(F.col("refine"), from_pairs(F.col("pulled"))).otherwise(F.col("points")).alias("points"))
