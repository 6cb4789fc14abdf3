"""Merging, shapes, scores and styles of strokes.

What Spark's expressions can say is a Column function: shapes, topology, styles, markup. Merging
is a fixpoint over the strokes of one glyph, a few dozen at most; it runs per glyph in pandas.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import glyphs
from . import points as P

Stroke = list[tuple[float, float]]

# ---- merging ----

TAIL = 8  # points that give a stroke's direction into a junction


class Glyph:
    """The strokes of a glyph and its junctions (sets of pixels), with the passes that join them.

    An end is at the first junction that has its pixel or one beside it. ``places`` and ``ends``
    are made anew for each step, as every step changes the strokes.
    """

    def __init__(self, strokes: Iterable[Sequence[Sequence[float]]], junctions: Sequence[Iterable[tuple[int, int]]] = ()):
        self.strokes: list[Stroke] = [[(p[0], p[1]) for p in s] for s in strokes]
        self.junctions = [set(j) for j in junctions]
        self.near: dict[tuple[int, int], int] = {}
        for number, pixels in enumerate(self.junctions):
            for x, y in pixels:
                for cell in ((x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)):
                    self.near.setdefault(cell, number)

    def at(self, p: tuple[float, float]) -> int:
        return self.near.get((round(p[0]), round(p[1])), -1)

    def places(self) -> list[tuple[int, int]]:
        """The junction (-1: none) of each stroke's start and end."""
        return [(self.at(s[0]), self.at(s[-1])) if s else (-1, -1) for s in self.strokes]

    def ends(self) -> dict[int, list[tuple[int, int]]]:
        """junction -> (stroke, side) of the ends there; side 0 is the start, 1 the end."""
        out: dict[int, list[tuple[int, int]]] = {}
        for k, pair in enumerate(self.places()):
            for side, junction in enumerate(pair):
                if junction >= 0:
                    out.setdefault(junction, []).append((k, side))
        return out

    def heading(self, k: int, side: int, n: int = 5) -> tuple[float, float]:
        """Unit vector along a stroke, in its own order, over the ``n`` steps at one side."""
        s = self.strokes[k]
        n = min(n, len(s) - 1)
        if n < 1:
            return 0.0, 0.0
        a, b = (s[-n - 1], s[-1]) if side else (s[0], s[n])
        size = math.hypot(b[0] - a[0], b[1] - a[1])
        return ((b[0] - a[0]) / size, (b[1] - a[1]) / size) if size >= 1e-9 else (0.0, 0.0)

    def bend(self, a: tuple[int, int], b: tuple[int, int]) -> float:
        """Half a turn less the angle between the headings of two ends: what a join there is judged by."""
        (ax, ay), (bx, by) = self.heading(*a), self.heading(*b)
        return math.pi - math.acos(max(-1.0, min(1.0, ax * bx + ay * by)))

    def join(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        """The second stroke becomes part of the first, which keeps its order."""
        (i, side), (j, other) = a, b
        first, second = self.strokes[i], self.strokes[j]
        if side:
            self.strokes[i] = first + (second[::-1] if other else second)
        else:
            self.strokes[i] = (second if other else second[::-1]) + first
        del self.strokes[j]

    def append(self, stub: int, stub_side: int, target: int, target_side: int) -> None:
        """A stub becomes part of a target, its named side last; the results to be matched have it that way."""
        s = self.strokes[stub] if stub_side else self.strokes[stub][::-1]
        t = self.strokes[target]
        self.strokes[target] = t + s[1:] if target_side else s[1:][::-1] + t
        del self.strokes[stub]

    def until_done(self, step: Callable[[], bool]) -> Glyph:
        while step():
            pass
        return self

    def by_direction(self, most: float = math.pi / 4, least_points: int = 0, least_ratio: float = 0.0) -> Glyph:
        """Join the two ends at a junction that bend least, until none bends less than ``most``."""

        def step() -> bool:
            places, best, pair = self.places(), most, None
            fit = [len(s) >= least_points and (p[0] < 0 or p[0] != p[1]) for s, p in zip(self.strokes, places, strict=True)]
            for ends in self.ends().values():
                ends = [e for e in ends if fit[e[0]]]
                for n, a in enumerate(ends):
                    for b in ends[n + 1 :]:
                        sizes = sorted((len(self.strokes[a[0]]), len(self.strokes[b[0]])))
                        if sizes[0] >= least_ratio * sizes[1] and (bend := self.bend(a, b)) < best:
                            best, pair = bend, (a, b)
            if pair:
                self.join(*pair)
            return pair is not None

        return self.until_done(step)

    def t_junctions(self, share: float = 0.4, most: float = 2 * math.pi / 3) -> Glyph:
        """Where three or more meet and the shortest is a short bar between junctions, join the two longest and drop the bar."""

        def step() -> bool:
            places = self.places()
            for junction, ends in self.ends().items():
                if len(ends) < 3:
                    continue
                ranked = sorted(ends, key=lambda e: -len(self.strokes[e[0]]))
                a, b, bar = ranked[0], ranked[1], ranked[-1][0]
                limit = share * len(self.strokes[b[0]])
                far = places[a[0]][1 - a[1]], places[b[0]][1 - b[1]]
                if min(places[bar]) < 0 or len(self.strokes[bar]) >= limit or a[0] == b[0] or far[0] >= 0 and far[0] == far[1]:
                    continue
                if self.bend(a, b) >= most:
                    continue
                self.join(a, b)
                for k, pair in enumerate(self.places()):
                    if min(pair) >= 0 and junction in pair and len(self.strokes[k]) < limit:
                        del self.strokes[k]
                        break
                return True
            return False

        return self.until_done(step)

    def _outward(self, k: int, place: tuple[int, int]) -> tuple[int, tuple[float, float]] | None:
        """Junction and free tip of a stub that leaves a junction and reaches no other."""
        s, (a, b) = self.strokes[k], place
        if a == b and a >= 0:
            pixels = self.junctions[a]
            x, y = sum(p[0] for p in pixels) / len(pixels), sum(p[1] for p in pixels) / len(pixels)
            return a, s[0] if math.hypot(s[0][0] - x, s[0][1] - y) > math.hypot(s[-1][0] - x, s[-1][1] - y) else s[-1]
        if a >= 0 > b:
            return a, s[-1]
        return (b, s[0]) if b >= 0 > a else None

    def _extend(self, k: int, side: int, junction: int, tip: tuple[float, float]) -> None:
        """Points from a stroke's end to the tip, if the stroke comes to its end from somewhere."""
        s, pixels = self.strokes[k], self.junctions[junction]
        inward = s[::-1] if side else s
        tail = [p for n, p in enumerate(inward) if n == 0 or (round(p[0]), round(p[1])) not in pixels][:TAIL]
        end, gap = inward[0], math.dist(inward[0], tip)
        if len(tail) < 2 or math.dist(tail[0], tail[-1]) < 1e-9 or gap < 1:
            return
        n = max(2, int(gap / 2))
        way = [(end[0] + (tip[0] - end[0]) * i / n, end[1] + (tip[1] - end[1]) * i / n) for i in range(1, n + 1)]
        self.strokes[k] = s + way if side else way[::-1] + s

    def converging_stubs(self, most_points: int = 18) -> Glyph:
        """A short stroke out of a junction of two others goes; the others run on to its tip."""

        def step() -> bool:
            places, ends = self.places(), self.ends()
            for k, s in enumerate(self.strokes):
                found = self._outward(k, places[k]) if 2 <= len(s) < most_points else None
                if found is None:
                    continue
                junction, tip = found
                others = [(j, side) for j, side in ends.get(junction, []) if j != k]
                if len(others) < 2:
                    continue
                for j in dict.fromkeys(j for j, _ in others):
                    self._extend(j, int((j, 1) in others), junction, tip)
                del self.strokes[k]
                return True
            return False

        return self.until_done(step)

    def junction_stubs(self, most_points: int = 20) -> Glyph:
        """A short stroke at a junction becomes part of the longest other there."""

        def step() -> bool:
            places, ends = self.places(), self.ends()
            for k, s in enumerate(self.strokes):
                if len(s) >= most_points:
                    continue
                best, longest = None, 0
                for junction in sorted({j for j in places[k] if j >= 0}):
                    for j, side in ends[junction]:
                        if j != k and len(self.strokes[j]) > longest:
                            best, longest = (0 if places[k][0] == junction else 1, j, side), len(self.strokes[j])
                if best:
                    self.append(k, *best)
                    return True
            return False

        return self.until_done(step)

    def near_stubs(self, most_points: int = 20, reach: float = 20) -> Glyph:
        """A short stroke becomes part of the longer one whose end is closest to one of its own."""

        def step() -> bool:
            for k, s in enumerate(self.strokes):
                if len(s) >= most_points:
                    continue
                found = [(math.dist(s[-own], t[-side]), n) for n, (own, j, side, t) in enumerate(self._pairs(k, most_points))]
                found = min(found, default=(math.inf, 0))
                if found[0] < reach:
                    own, j, side, _ = self._pairs(k, most_points)[found[1]]
                    self.append(k, own, j, side)
                    return True
            return False

        return self.until_done(step)

    def _pairs(self, k: int, least: int) -> list[tuple[int, int, int, Stroke]]:
        return [(own, j, side, t) for own in (0, 1) for j, t in enumerate(self.strokes) if j != k and len(t) >= least for side in (0, 1)]

    def orphans(self, most_points: int = 20) -> Glyph:
        """A short stroke alone at one of its junctions goes."""

        def step() -> bool:
            places, ends = self.places(), self.ends()
            for k, s in enumerate(self.strokes):
                if len(s) < most_points and any(len({j for j, _ in ends[c]}) <= 1 for c in places[k] if c >= 0):
                    del self.strokes[k]
                    return True
            return False

        return self.until_done(step)

    def to_count(self, counts: Sequence[int]) -> Glyph:
        """Join the strokes whose ends are closest until there are as few as the template has; unchanged if a template has this many."""
        while counts and len(self.strokes) not in counts and len(self.strokes) > max(1, min(counts)):
            options = [(math.dist(s[-a], t[-b]), i, j, b) for i, s in enumerate(self.strokes) for j, t in enumerate(self.strokes) if i < j and s and t for a in (0, 1) for b in (0, 1)]
            if not options:
                break
            _, i, j, flipped = min(options, key=lambda o: o[0])
            self.strokes[i] = self.strokes[i] + (self.strokes[j][::-1] if flipped else self.strokes[j])
            del self.strokes[j]
        return self


@dataclass(frozen=True)
class Preset:
    """How far the merge passes go."""

    bend: float
    converging: int
    stub: int
    reach: int


#: The three presets.
PRESETS = {"default": Preset(math.pi / 4, 18, 20, 20), "aggressive": Preset(math.pi / 3, 25, 25, 25), "conservative": Preset(math.pi / 6, 12, 15, 15)}

#: The passes of a pipeline by name; a user adds their own (glyph, preset) -> None.
PASSES: dict[str, Callable[[Glyph, Preset], object]] = {
    "direction": lambda g, p: g.by_direction(p.bend),
    "t_junctions": lambda g, p: g.t_junctions(),
    "converging_stubs": lambda g, p: g.converging_stubs(p.converging),
    "junction_stubs": lambda g, p: g.junction_stubs(p.stub),
    "near_stubs": lambda g, p: g.near_stubs(p.stub, p.reach),
    "orphans": lambda g, p: g.orphans(p.stub),
}


def merge_pipeline(strokes: Iterable[Sequence[Sequence[float]]], junctions: Sequence[Iterable[tuple[int, int]]] = (), preset: str = "default", passes: Sequence[str] | None = None) -> list[Stroke]:
    """The strokes after all passes, in order."""
    g = Glyph(strokes, junctions)
    for name in passes or PASSES:
        PASSES[name](g, PRESETS[preset])
    return g.strokes


MERGED = "glyph long, stroke int, points array<struct<x:double,y:double>>"


def merged_batch(batch: pa.RecordBatch, preset: str, passes: Sequence[str] | None) -> pa.RecordBatch:
    """glyph, stroke, points after merging the glyphs of a batch (glyph, lines, dots); coordinates stay in Arrow's columns on the way in and out."""
    lines, dots = batch.column("lines"), batch.column("dots")
    points = lines.flatten().field("points")
    xs, ys = (points.flatten().field(k).cast(pa.float64()).to_numpy(zero_copy_only=False).tolist() for k in "xy")
    sizes, counts = (np.cumsum([0, *(n or 0 for n in pa.compute.list_value_length(v).to_pylist())]).tolist() for v in (points, lines))
    where, px, py = (dots.flatten().field(k).to_pylist() for k in ("junction", "x", "y"))
    pixels = np.cumsum([0, *pa.compute.list_value_length(dots).to_pylist()]).tolist()
    glyphs_, numbers, lengths, flat = [], [], [0], []
    for n, glyph in enumerate(batch.column("glyph").to_pylist()):
        strokes = [list(zip(xs[sizes[k] : sizes[k + 1]], ys[sizes[k] : sizes[k + 1]], strict=True)) for k in range(counts[n], counts[n + 1])]
        sets: dict[object, set[tuple[int, int]]] = {}
        for k in range(pixels[n], pixels[n + 1]):
            sets.setdefault(where[k], set()).add((px[k], py[k]))
        for number, stroke in enumerate(merge_pipeline(strokes, [sets[j] for j in sorted(sets)], preset, passes)):
            glyphs_.append(glyph)
            numbers.append(number)
            flat += stroke
            lengths.append(len(flat))
    places = np.array(flat, float).reshape(-1, 2)
    out = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.StructArray.from_arrays([pa.array(places[:, 0]), pa.array(places[:, 1])], names=["x", "y"]))
    return pa.RecordBatch.from_arrays([pa.array(glyphs_, pa.int64()), pa.array(numbers, pa.int32()), out], names=["glyph", "stroke", "points"])


def merge_strokes(strokes: DataFrame, junctions: DataFrame, preset: str = "default", passes: Sequence[str] | None = None) -> DataFrame:
    """glyph, stroke, points after merging: ``strokes`` has glyph, stroke, points; ``junctions`` has glyph, junction, x, y.

    A glyph is bounded by its canvas: its strokes and pixels are one row, and Python gets many rows at once.
    """
    from ..session import ship

    ship(strokes.sparkSession)
    dot = F.struct("junction", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    dots = junctions.where("junction IS NOT NULL").select("glyph", dot.alias("dot"))
    rows = strokes.select("glyph", F.struct("stroke", "points").alias("line")).unionByName(dots, allowMissingColumns=True)
    each = rows.groupBy(F.col("glyph").cast("long").alias("glyph")).agg(F.sort_array(F.collect_list("line")).alias("lines"), F.collect_list("dot").alias("dots")).where(F.size("lines") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (merged_batch(b, preset, passes) for b in batches)

    return each.mapInArrow(run, MERGED)


def cluster_junctions(pixels: Iterable[tuple[int, int]], apart: float = 12.0) -> list[set[tuple[int, int]]]:
    """8-connected groups of junction pixels; then, first pairs first, groups whose centres are closer than ``apart`` become one."""
    left, groups = set(pixels), []
    for start in sorted(left):
        if start not in left:
            continue
        left.discard(start)
        group, todo = {start}, [start]
        while todo:
            x, y = todo.pop()
            for q in ((x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)):
                if q in left:
                    left.discard(q)
                    group.add(q)
                    todo.append(q)
        groups.append(group)
    while True:
        centres = [np.mean(list(g), axis=0) for g in groups]
        close = next(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)) if math.dist(centres[i], centres[j]) < apart), None)
        if close is None:
            return groups
        groups[close[0]] |= groups.pop(close[1])


# ---- shapes ----


@dataclass(frozen=True)
class Shape:
    """A parametric shape in fractions of a box: bounds of its parameters, and its point at t from 0 to 1, as Columns."""

    bounds: tuple[tuple[float, float], ...]
    at: Callable[[Callable[[int], Column], Column], tuple[Column, Column]]
    closed: bool = False

    @property
    def defaults(self) -> tuple[float, ...]:
        return tuple((low + high) / 2 for low, high in self.bounds)

    def valid(self, params: Sequence[float]) -> bool:
        return len(params) == len(self.bounds) and all(low <= v <= high for v, (low, high) in zip(params, self.bounds, strict=True))

    def points(self, params: Column, box: Column, n: int, dx: float = 0.0, dy: float = 0.0) -> Column:
        """``n`` points of the shape with these parameters (array<double>) in a box."""
        get = lambda i: F.get(params, F.lit(i))

        def place(k: Column) -> Column:
            x, y = self.at(get, k / F.lit(float(n if self.closed else max(1, n - 1))))
            return P.point(box["x_min"] + x * P.box_width(box) + dx, box["y_min"] + y * P.box_height(box) + dy)

        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), place)


def _ellipse(start: Callable | float, end: Callable | float, sign: int) -> Callable:
    """Points of an ellipse (centre, radii in p0..p3) between two angles in radians; the sign turns it left or right."""

    def at(p: Callable[[int], Column], t: Column) -> tuple[Column, Column]:
        a, b = (v(p) if callable(v) else F.lit(float(v)) for v in (start, end))
        turn = a + (b - a) * t
        return p(0) + sign * p(2) * F.cos(turn), p(1) + p(3) * F.sin(turn)

    return at


_ANGLES = (lambda p: F.radians(p(4)), lambda p: F.radians(p(5)))
_UNIT, _HALVES = (0.0, 1.0), ((0.0, 0.5), (0.5, 1.0))
_ARC = ((0.05, 0.8), (0.05, 0.8), (-180.0, 0.0), (0.0, 180.0))

#: name -> shape; a user may add more. The bounds are fixed values.
SHAPES: dict[str, Shape] = {
    "vline": Shape((_UNIT, *_HALVES), lambda p, t: (p(0), p(1) + t * (p(2) - p(1)))),
    "hline": Shape((_UNIT, *_HALVES), lambda p, t: (p(1) + t * (p(2) - p(1)), p(0))),
    "diag": Shape((_UNIT,) * 4, lambda p, t: (p(0) + t * (p(2) - p(0)), p(1) + t * (p(3) - p(1)))),
    "arc_right": Shape(((0.0, 0.8), _UNIT, *_ARC), _ellipse(*_ANGLES, 1)),
    "arc_left": Shape(((0.2, 1.0), _UNIT, *_ARC), _ellipse(*_ANGLES, -1)),
    "loop": Shape(((0.1, 0.9), (0.1, 0.9), (0.1, 0.6), (0.1, 0.6)), _ellipse(0, math.tau, 1), True),
    "u_arc": Shape(((0.1, 0.9), (0.2, 1.0), (0.1, 0.6), (0.1, 0.6)), _ellipse(0, math.pi, -1)),
}


def parameter_bounds(templates: Sequence[dict]) -> tuple[list[tuple[float, float]], list[tuple[int, int]]]:
    """Bounds of all parameters of templates ({"shape", "bounds" overriding some}) in a row, and each shape's span in it."""
    rows = [[own if own is not None else given for given, own in zip(SHAPES[t["shape"]].bounds, [*(t.get("bounds") or ()), *[None] * 9], strict=False)] for t in templates]
    ends = np.cumsum([0, *map(len, rows)]).tolist()
    return [b for r in rows for b in r], list(zip(ends[:-1], ends[1:], strict=True))


def shapes_of(vector: Column, kinds: Sequence[str], spans: Sequence[tuple[int, int]], box: Column, n: int = 60) -> Column:
    """The point arrays of all shapes of a parameter vector."""
    return F.array(*[SHAPES[k].points(F.slice(vector, a + 1, b - a), box, n) for k, (a, b) in zip(kinds, spans, strict=True)])


def sample_count(width: float, height: float, spacing: float = 1.5, least: int = 60) -> int:
    """Points of a shape in a box so that they lie about ``spacing`` apart."""
    return max(least, int(math.hypot(width, height) / spacing))


# ---- scores ----


@dataclass
class Canvas:
    """A mask with what scoring needs of it."""

    mask: np.ndarray
    radius: float
    stride: int = 2
    cloud: np.ndarray = field(init=False)
    depth: np.ndarray = field(init=False)

    def __post_init__(self):
        ys, xs = np.nonzero(self.mask[:: self.stride, :: self.stride])
        self.cloud = np.stack([xs, ys], axis=1) * self.stride
        self.depth = np.sqrt(glyphs.distance_squared(~self.mask)[0]) if not self.mask.all() else np.full(self.mask.shape, np.inf)
        _, self.near_y, self.near_x = glyphs.distance_squared(self.mask)

    def pixels(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.clip(np.rint(points[:, i]).astype(int), 0, self.mask.shape[1 - i] - 1) for i in (0, 1))

    def snapped(self, points: np.ndarray) -> np.ndarray:
        x, y = self.pixels(points)
        return np.stack([self.near_x[y, x], self.near_y[y, x]], axis=1).astype(float)

    def covered(self, points: np.ndarray) -> set[int]:
        """The cloud points within the radius of a point; a strip of points at a time."""
        hit = np.zeros(len(self.cloud), bool)
        for part in range(0, len(points), 256):
            gap = self.cloud[:, None, :] - points[None, part : part + 256, :]
            hit |= ((gap**2).sum(axis=2) <= self.radius**2).any(axis=1)
        return set(np.flatnonzero(hit).tolist())


Penalty = Callable[[np.ndarray, np.ndarray, list[set[int]], Canvas], float]


def off_mask(points: np.ndarray, snapped: np.ndarray, covered: list[set[int]], canvas: Canvas) -> float:
    """Share of the points more than half a pixel from the mask."""
    return float((np.hypot(*(points - snapped).T) > 0.5).mean())


def at_edge(points: np.ndarray, snapped: np.ndarray, covered: list[set[int]], canvas: Canvas) -> float:
    """Share of the points less than 1.5 pixels deep in the mask."""
    x, y = canvas.pixels(snapped)
    return float((canvas.depth[y, x] < 1.5).mean())


def overlapping(points: np.ndarray, snapped: np.ndarray, covered: list[set[int]], canvas: Canvas) -> float:
    """Mean over shapes of the share of their cover that others have too, beyond a quarter."""
    out = 0.0
    for i, own in enumerate(covered):
        others = set().union(*(c for j, c in enumerate(covered) if j != i))
        out += max(0.0, len(own & others) / len(own) - 0.25) if own else 0.0
    return out / len(covered) if len(covered) > 1 else 0.0


class Scorer:
    """Coverage of a mask's point cloud less weighted penalties, as a number to be minimised; penalties are added and removed by name."""

    def __init__(self, penalties: dict[str, tuple[float, Penalty]] | None = None):
        self.penalties = dict(penalties if penalties is not None else {"snap": (0.5, off_mask), "edge": (0.1, at_edge), "overlap": (0.5, overlapping)})

    def add(self, name: str, weight: float, penalty: Penalty) -> Scorer:
        self.penalties[name] = weight, penalty
        return self

    def remove(self, name: str) -> bool:
        return self.penalties.pop(name, None) is not None

    def __call__(self, strokes: Sequence[np.ndarray], canvas: Canvas) -> float:
        strokes = [np.asarray(s, float) for s in strokes if len(s) >= 2]
        if not strokes or not len(canvas.cloud):
            return 0.0
        points = np.concatenate(strokes)
        snapped = canvas.snapped(points)
        parts = np.split(snapped, np.cumsum([len(s) for s in strokes])[:-1])
        covered = [canvas.covered(p) for p in parts]
        return sum(w * f(points, snapped, covered, canvas) for w, f in self.penalties.values()) - len(set().union(*covered)) / len(canvas.cloud)


def score_strokes(df: DataFrame, radius: float = 6.0, stride: int = 2, scorer: Scorer | None = None) -> DataFrame:
    """glyph, score of rows (glyph, mask, width, strokes): one row is one glyph."""
    from ..session import ship

    ship(df.sparkSession)
    judge = scorer or Scorer()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            scores = [judge([np.array([(p["x"], p["y"]) for p in s], float) for s in strokes], Canvas(glyphs.mask_of(m, w), radius, stride)) for m, w, strokes in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["glyph", "score"])

    return df.select("glyph", "mask", "width", "strokes").mapInArrow(run, f"glyph {df.schema['glyph'].dataType.simpleString()}, score double")


def topology(strokes: Column, template: Column, box: Column, tolerance: float = 0.2) -> Column:
    """score, hits, total: the waypoints of a template (array<array<string>>) that their strokes pass; 0 of 0 where the counts of strokes differ."""
    axis = lambda region, k: F.element_at(F.create_map(*[x for r, a in P.ANCHORS.items() for x in (F.lit(r), F.lit(float(a[k])))]), region)
    near = lambda p, r: (F.abs((p["x"] - box["x_min"]) / P.box_width(box) - axis(r, 0)) <= tolerance) & (F.abs((p["y"] - box["y_min"]) / P.box_height(box) - axis(r, 1)) <= tolerance)

    def hits(pair: Column) -> Column:
        return F.size(F.filter(pair["t"], lambda w: F.exists(pair["s"], lambda p: near(p, F.regexp_extract(w, r"(\d)", 1).cast("int")))))

    pairs = F.arrays_zip(strokes.alias("s"), template.alias("t"))
    same = (F.size(strokes) == F.size(template)) & (P.box_width(box) > 0) & (P.box_height(box) > 0)
    n = F.when(same, F.aggregate(F.transform(pairs, hits), F.lit(0), lambda a, b: a + b)).otherwise(0)
    total = F.when(F.size(strokes) == F.size(template), F.aggregate(F.transform(template, lambda t: F.size(t)), F.lit(0), lambda a, b: a + b)).otherwise(0)
    return F.struct(F.coalesce(F.try_divide(n, total), F.lit(0.0)).alias("score"), n.alias("hits"), total.alias("total"))


def taper(widths: Column) -> Column:
    """Mean width of the ends over that of the middle half; 1 for fewer than four points."""
    n = F.size(widths)
    first, last = F.floor(n / 4).cast("int"), F.floor(3 * n / 4).cast("int")
    middle = F.slice(widths, first + 1, F.greatest(F.lit(1), last - first))
    mean = P.total(middle) / F.size(middle)
    return F.when(n < 4, 1.0).otherwise((F.get(widths, F.lit(0)) + F.get(widths, n - 1)) / 2 / F.greatest(mean, F.lit(1e-6)))


def self_overlaps(points: Column, widths: Column) -> Column:
    """Points closer to one more than two places off in the same stroke than half the larger width."""
    n = F.size(points)
    index = F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1))

    def touched(i: Column) -> Column:
        return F.exists(index, lambda j: (F.abs(i - j) > 2) & (P.distance(F.get(points, i), F.get(points, j)) < F.greatest(F.get(widths, i), F.get(widths, j)) / 2))

    return F.when(n < 5, 0).otherwise(F.size(F.filter(index, touched)))


# ---- styles ----


def slanted(points: Column, slant: float, centre: Column) -> Column:
    return F.transform(points, lambda p: P.point(p["x"] + slant * (p["y"] - centre["y"]), p["y"]))


def stretched(points: Column, sx: float, sy: float, centre: Column) -> Column:
    return F.transform(points, lambda p: P.point(centre["x"] + (p["x"] - centre["x"]) * sx, centre["y"] + (p["y"] - centre["y"]) * sy))


def waved(points: Column, index: Column, amplitude: float, frequency: float) -> Column:
    """Shifted up or down by a wave over the places of the characters in a line."""
    return F.transform(points, lambda p: P.point(p["x"], p["y"] + amplitude * F.sin(index * frequency * math.tau)))


def trembling(points: Column, amplitude: float, frequency: float) -> Column:
    return F.transform(points, lambda p, i: P.point(p["x"] + amplitude * F.sin(i * frequency * math.tau), p["y"] + amplitude * F.cos(i * frequency * math.tau * 1.3)))


def noise(seed: Column, at: Column, spread: float) -> Column:
    """Normal noise from a hash of (seed, place): the same on every run and partition, by the sum of two uniform draws' polar form."""
    u = lambda k: (F.pmod(F.xxhash64(seed, at, F.lit(k)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    return spread * F.sqrt(-2 * F.log(u(0))) * F.cos(math.tau * u(1))


def jittered(points: Column, seed: Column, spread: float) -> Column:
    return F.transform(points, lambda p, i: P.point(p["x"] + noise(seed, 2 * i, spread), p["y"] + noise(seed, 2 * i + 1, spread)))


def wandering(points: Column, seed: Column, spread: float) -> Column:
    """Inner points moved across the line between their neighbours."""
    n = F.size(points)

    def move(p: Column, i: Column) -> Column:
        a, b = F.get(points, i - 1), F.get(points, i + 1)
        d = P.distance(a, b)
        k = noise(seed, i, spread)
        return F.when((i == 0) | (i == n - 1) | (d == 0), p).otherwise(P.point(p["x"] - F.try_divide(b["y"] - a["y"], d) * k, p["y"] + F.try_divide(b["x"] - a["x"], d) * k))

    return F.transform(points, move)


@dataclass(frozen=True)
class Style:
    """A writer's hand; what is 0 (or 1 for factors) changes nothing."""

    slant: float = 0.0
    aspect: float = 1.0
    scale: float = 1.0
    rotation: float = 0.0
    shift: float = 0.0
    wave: float = 0.0
    wave_frequency: float = 0.0
    wander: float = 0.0
    noise: float = 0.0
    tremor: float = 0.0
    tremor_frequency: float = 0.0

    def apply(self, points: Column, seed: Column, index: Column) -> Column:
        """Slant, aspect, scale, jitter of the whole character, wave, wander of the line, noise and tremor of its points, in this order."""
        centre = P.box_centre(P.box(points))
        out = slanted(points, self.slant, centre) if self.slant else points
        out = stretched(out, self.aspect * self.scale, self.scale, centre) if (self.aspect, self.scale) != (1.0, 1.0) else out
        if self.rotation or self.shift:
            angle = F.radians(noise(seed, F.lit(-1), self.rotation))
            dx, dy = noise(seed, F.lit(-2), self.shift), noise(seed, F.lit(-3), self.shift)
            c, s = F.cos(angle), F.sin(angle)
            turned = out
            out = F.transform(turned, lambda p: P.point(centre["x"] + (p["x"] - centre["x"]) * c - (p["y"] - centre["y"]) * s + dx, centre["y"] + (p["x"] - centre["x"]) * s + (p["y"] - centre["y"]) * c + dy))
        out = waved(out, index, self.wave, self.wave_frequency) if self.wave else out
        out = wandering(out, seed, self.wander) if self.wander else out
        out = jittered(out, seed, self.noise) if self.noise else out
        return trembling(out, self.tremor, self.tremor_frequency) if self.tremor else out


def uniform(seed: Column, low: float, high: float) -> Column:
    """A number between two bounds from a hash of the seed."""
    return low + (high - low) * F.pmod(F.xxhash64(seed), F.lit(1 << 40)) / float(1 << 40)


def augmented(points: Column, seed: Column) -> Column:
    """Scaled by 0.8 to 1.2 and turned by up to 0.17 radians about the origin, by a hash of the seed."""
    k, a = uniform(F.concat_ws("/", seed.cast("string"), F.lit("scale")), 0.8, 1.2), uniform(F.concat_ws("/", seed.cast("string"), F.lit("angle")), -0.17, 0.17)
    return F.transform(points, lambda p: P.point(k * (p["x"] * F.cos(a) - p["y"] * F.sin(a)), k * (p["x"] * F.sin(a) + p["y"] * F.cos(a))))


# ---- tokens, markup, images ----


def detokenised(tokens: Column, start: int, offset: int, size: int = 224) -> Column:
    """Strokes of a token sequence: a start token begins a stroke, then pairs of x and ``offset`` + y; odd ones are skipped.

    Strokes are cut at the start tokens; a start token never is the second of a pair.
    """
    t = F.concat(tokens, F.array(F.lit(start)).cast("array<int>"))
    marks = F.filter(F.transform(t, lambda v, i: F.when(v == start, i)), lambda i: i.isNotNull())
    cuts = F.concat(F.array(F.lit(-1)), marks)

    def stroke(k: Column) -> Column:
        part = F.slice(t, F.get(cuts, k) + 2, F.get(cuts, k + 1) - F.get(cuts, k) - 1)
        n = F.floor(F.size(part) / 2).cast("int")
        pairs = F.when(n == 0, F.array().cast("array<struct<x:double,y:double>>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: P.point(F.get(part, 2 * i), F.get(part, 2 * i + 1) - offset)))
        return F.filter(pairs, lambda p: p["x"].between(0, size - 1) & p["y"].between(0, size - 1))

    strokes = F.transform(F.sequence(F.lit(0), F.size(cuts) - 2), stroke)
    return F.filter(strokes, lambda s: F.size(s) > 0)


def to_svg(strokes: Column, width: float = 2.0, canvas: int = 224) -> Column:
    """An SVG document of the strokes of two points or more."""
    xy = lambda p: F.concat(F.format_string("%.1f", p["x"]), F.lit(" "), F.format_string("%.1f", p["y"]))
    path = lambda s: F.concat(F.lit('  <path d="M '), F.array_join(F.transform(s, xy), " L "), F.lit(f'" fill="none" stroke="black" stroke-width="{width}" stroke-linecap="round" stroke-linejoin="round"/>'))
    body = F.array_join(F.transform(F.filter(strokes, lambda s: F.size(s) >= 2), path), "\n")
    return F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {canvas} {canvas}">\n'), body, F.lit("\n</svg>"))


def to_json(word: Column, asset: Column, strokes: Column) -> Column:
    return F.to_json(F.struct(word.alias("word"), asset.alias("font"), F.transform(strokes, lambda s: F.transform(s, lambda p: F.array(p["x"], p["y"]))).alias("strokes")))


def pixel_contours(contours: Column, units: Column, ascent: Column, size: float, dx: Column, dy: Column, apart: float | None = 0.5) -> Column:
    """Contours in font units (upwards) as pixels (downwards), closed where their ends lie more than ``apart`` pixels from each other, or all with None."""
    k = size / units
    place = lambda p: P.point(p["x"] * k + dx, (ascent - p["y"]) * k + dy)
    ends = lambda c: P.distance(F.get(c, F.lit(0)), F.get(c, F.size(c) - 1))
    gap = lambda c: F.lit(True) if apart is None else ends(c) > apart
    return F.transform(F.transform(contours, lambda c: F.transform(c, place)), lambda c: F.when((F.size(c) >= 2) & gap(c), F.concat(c, F.array(F.get(c, F.lit(0))))).otherwise(c))


def contour_segments(contours: Column) -> Column:
    """The segments (a, b) between neighbouring points of all contours."""
    of = lambda p: F.transform(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), lambda a, i: F.struct(a.alias("a"), F.get(p, i + 1).alias("b")))
    return F.flatten(F.transform(contours, of))


def contour_strokes(contours: Column) -> Column:
    """The contour of most points as two strokes, from its top to its bottom and from there on around to the top again.

    One stroke where all points are of one height; null without a contour of four points or more.
    """
    sizes = F.transform(contours, F.size)
    outer = F.get(contours, (F.array_position(sizes, F.array_max(sizes)) - 1).cast("int"))

    def halves(o: Column) -> Column:
        ys = F.transform(o, lambda p: p["y"])
        ends = F.struct(F.array_position(ys, F.array_min(ys)).cast("int").alias("top"), F.array_position(ys, F.array_max(ys)).cast("int").alias("low"), o.alias("o"))

        def cut(e: Column) -> Column:
            o, top, low, n = e["o"], e["top"], e["low"], F.size(e["o"])
            between = lambda a, b: F.slice(o, a, b - a + 1)
            around = lambda a, b: F.concat(between(a, n), between(F.lit(1), b))
            down = F.when(top < low, between(top, F.greatest(low, top))).otherwise(around(top, low))
            up = F.when(top < low, around(low, top)).otherwise(between(low, F.greatest(low, top)))
            return F.when(top == low, F.array(o)).otherwise(F.array(down, up))

        return P.let(ends, cut)

    return F.when(F.size(outer) >= 4, P.let(outer, halves))


# ---- joined writing ----


def contextual_difference(pairs: DataFrame, key: str = "glyph", threshold: float = 0.10) -> DataFrame:
    """key, contextual_score, has_contextual: mean difference of the hashes (array<bigint>, 256 bits as a rule) of each letter in two surroundings; letters without both are left out."""
    bits = F.aggregate(F.zip_with("first", "second", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    gap = bits / (64.0 * F.size("first"))
    score = F.coalesce(F.avg(gap), F.lit(0.0))
    return pairs.groupBy(key).agg(score.alias("contextual_score")).withColumn("has_contextual", F.col("contextual_score") >= threshold)


def joined_writing(connectivity: Column, contextual: Column, least: float = 0.7, threshold: float = 0.10) -> Column:
    """is_cursive and the methods that say so."""
    methods = F.array_compact(F.array(F.when(connectivity >= least, "connectivity"), F.when(contextual >= threshold, "contextual")))
    return F.struct((F.size(methods) > 0).alias("is_cursive"), methods.alias("methods"))
