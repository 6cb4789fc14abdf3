"""Functions on arrays of points (``array<struct<x, y>>``), boxes and the nine-cell numpad grid."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Anchor of each numpad cell as fractions of the box.
ANCHORS = {r: (((r - 1) % 3) / 2, (2 - (r - 1) // 3) / 2) for r in range(1, 10)}
ZERO = 0.0


def point(x: Column | float, y: Column | float) -> Column:
    lift = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(lift(x).cast("double").alias("x"), lift(y).cast("double").alias("y"))


def from_pairs(flat: Column) -> Column:
    """A flat array x0, y0, x1, y1, ... as points."""
    n = F.floor(F.size(flat) / 2).cast("int")
    return F.when(n == 0, F.array().cast("array<struct<x:double,y:double>>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: point(F.get(flat, 2 * i), F.get(flat, 2 * i + 1))))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def add(a: Column, b: Column) -> Column:
    return point(a["x"] + b["x"], a["y"] + b["y"])


def subtract(a: Column, b: Column) -> Column:
    return point(a["x"] - b["x"], a["y"] - b["y"])


def scaled(a: Column, k: Column | float) -> Column:
    return point(a["x"] * k, a["y"] * k)


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"]


def length(a: Column) -> Column:
    return F.sqrt(a["x"] * a["x"] + a["y"] * a["y"])


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def normalised(a: Column, least: float = 0.01) -> Column:
    """Unit vector; zero for a vector shorter than ``least``."""
    n = length(a)
    return F.when(n < least, point(0.0, 0.0)).otherwise(point(F.try_divide(a["x"], n), F.try_divide(a["y"], n)))


def angle_between(a: Column, b: Column) -> Column:
    """Radians between unit vectors; the dot product is clamped first."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


def heading(dx: Column, dy: Column) -> Column:
    return F.when(F.sqrt(dx * dx + dy * dy) <= 0.01, 0.0).otherwise(F.degrees(F.atan2(dy, dx)))


def steps(points: Column) -> Column:
    """Differences to the point before; (0, 0) for the first."""
    return F.transform(points, lambda p, i: F.when(i == 0, point(0.0, 0.0)).otherwise(subtract(p, F.get(points, i - 1))))


def running(deltas: Column) -> Column:
    """Prefix sums of deltas: relative to absolute."""
    start = F.array().cast("array<struct<x:double,y:double>>")
    return F.aggregate(deltas, start, lambda acc, d: F.concat(acc, F.array(F.when(F.size(acc) == 0, d).otherwise(add(F.element_at(F.when(F.size(acc) == 0, F.array(d)).otherwise(acc), -1), d)))))


def path_length(points: Column) -> Column:
    return total(F.transform(steps(points), length))


def sinuosity(points: Column) -> Column:
    """Path length over the distance of the ends."""
    return F.try_divide(path_length(points), distance(F.get(points, F.lit(0)), F.get(points, F.size(points) - 1)))


def without_repeats(points: Column) -> Column:
    """Points unlike the one before."""
    return F.filter(points, lambda p, i: (i == 0) | (p != F.get(points, i - 1)))


def box(points: Column) -> Column:
    """Bounding box; all zero for no points."""
    side = lambda f, axis: F.coalesce(f(F.transform(points, lambda p: p[axis])), F.lit(0.0))
    return F.struct(side(F.array_min, "x").alias("x_min"), side(F.array_min, "y").alias("y_min"), side(F.array_max, "x").alias("x_max"), side(F.array_max, "y").alias("y_max"))


def box_width(b: Column) -> Column:
    return b["x_max"] - b["x_min"]


def box_height(b: Column) -> Column:
    return b["y_max"] - b["y_min"]


def box_centre(b: Column) -> Column:
    return point((b["x_min"] + b["x_max"]) / 2, (b["y_min"] + b["y_max"]) / 2)


def box_contains(b: Column, p: Column) -> Column:
    return p["x"].between(b["x_min"], b["x_max"]) & p["y"].between(b["y_min"], b["y_max"])


def centroid(points: Column) -> Column:
    n = F.size(points)
    return point(F.try_divide(total(F.transform(points, lambda p: p["x"])), n), F.try_divide(total(F.transform(points, lambda p: p["y"])), n))


def affine(points: Column, tx: float = 0, ty: float = 0, sx: float = 1, sy: float = 1, theta: float = 0, shear: float = 0, about: Column | None = None) -> Column:
    """Scale, shear, rotate (radians) about the centroid, then shift."""
    c = centroid(points) if about is None else about
    cos, sin = math.cos(theta), math.sin(theta)

    def move(p: Column) -> Column:
        x, y = (p["x"] - c["x"]) * sx, (p["y"] - c["y"]) * sy
        x = x + shear * y
        return point(x * cos - y * sin + c["x"] + tx, x * sin + y * cos + c["y"] + ty)

    return F.transform(points, move)


def affine_by_parts(points: Column, tx: float = 0, ty: float = 0, sx: float = 1, sy: float = 1, degrees: float = 0, shear: float = 0, about: Column | None = None) -> Column:
    """The other order: turn (degrees) and shear about a centre, then scale, then shift."""
    c = centroid(points) if about is None else about
    cos, sin = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))

    def move(p: Column) -> Column:
        dx, dy = p["x"] - c["x"], p["y"] - c["y"]
        return point(c["x"] + sx * (dx * cos - dy * sin + shear * dy) + tx, c["y"] + sy * (dx * sin + dy * cos) + ty)

    return F.transform(points, move)


def to_height(points: Column, height: float) -> Column:
    """Shifted to the box's centre and scaled evenly to a height; unchanged in size where there is none."""
    b = box(points)
    k = F.when(box_height(b) == 0, 1.0).otherwise(F.try_divide(F.lit(float(height)), box_height(b)))
    return F.transform(points, lambda p: scaled(subtract(p, box_centre(b)), k))


def reversed_to(points: Column, flip: Column) -> Column:
    return F.when(flip, F.reverse(points)).otherwise(points)


def pen_rows(strokes: Column) -> Column:
    """Strokes as flat (x, y, pen); pen is 1 on the last point of each."""
    one = lambda s: F.transform(s, lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), (i == F.size(s) - 1).cast("int").alias("pen")))
    return F.flatten(F.transform(strokes, one))


def five_state(rows: Column) -> Column:
    """(dx, dy, pen) as (dx, dy, down, up, end); the last row is the end alone."""

    def state(r: Column, i: Column) -> Column:
        end = i == F.size(rows) - 1
        return F.array(r["x"].cast("double"), r["y"].cast("double"), (~end & (r["pen"] == 0)).cast("double"), (~end & (r["pen"] == 1)).cast("double"), end.cast("double"))

    return F.transform(rows, state)


def padded(values: Column, n: int, pad: Column) -> tuple[Column, Column]:
    """Cut or filled to ``n``, and the mask of real entries."""
    kept = F.slice(values, 1, n)
    fill = F.lit(n) - F.size(kept)
    return F.concat(kept, F.array_repeat(pad, fill)), F.concat(F.transform(kept, lambda v: F.lit(1)), F.array_repeat(F.lit(0), fill))


def sampled_line(a: Column, b: Column, spacing: float = 2.0) -> Column:
    """Points every ``spacing`` from a to b, both included."""
    n = F.greatest(F.lit(1), F.floor(distance(a, b) / spacing).cast("int"))
    return F.transform(F.sequence(F.lit(0), n), lambda i: point(a["x"] + (b["x"] - a["x"]) * i / n, a["y"] + (b["y"] - a["y"]) * i / n))


def bezier(controls: list[Column], n: int) -> Column:
    """``n + 1`` points of the Bezier curve of any degree."""
    d = len(controls) - 1

    def at(i: Column) -> Column:
        t = i / F.lit(float(n))
        axis = lambda name: sum((math.comb(d, k) * F.pow(1 - t, d - k) * F.pow(t, k) * c[name] for k, c in enumerate(controls)), F.lit(0.0))
        return point(axis("x"), axis("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(n)), at)


def catmull_rom(points: Column, n: int) -> Column:
    """The uniform Catmull-Rom spline through the points, ``n`` samples a segment; end points are repeated."""
    size = F.size(points)
    at = lambda i: F.get(points, F.greatest(F.lit(0), F.least(size - 1, i)))

    def sample(j: Column) -> Column:
        i, t = F.floor(j / n).cast("int"), (j % n) / F.lit(float(n))
        p0, p1, p2, p3 = at(i - 1), at(i), at(i + 1), at(i + 2)
        axis = lambda a: 0.5 * (2 * p1[a] + (p2[a] - p0[a]) * t + (2 * p0[a] - 5 * p1[a] + 4 * p2[a] - p3[a]) * t * t + (3 * p1[a] - p0[a] - 3 * p2[a] + p3[a]) * t * t * t)
        return point(axis("x"), axis("y"))

    return F.when(size < 2, points).otherwise(F.transform(F.sequence(F.lit(0), (size - 1) * n), sample))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def resampled(points: Column, n: int, also: Sequence[str] = ()) -> Column:
    """``n`` points at equal arc lengths by linear interpolation; fewer than two points or no length: unchanged. ``also``: further fields, such as a time."""
    start = F.array().cast("array<double>")
    marks = F.aggregate(F.transform(steps(points), length), start, lambda acc, v: F.concat(acc, F.array(v + F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0.0)))))

    def along(s: Column) -> Column:
        p, m = s["p"], s["m"]
        whole = F.element_at(m, -1)

        def at(k: Column) -> Column:
            target = whole * k / F.lit(float(max(1, n - 1)))

            def between(i: Column) -> Column:
                a, b, low, high = F.get(p, i), F.get(p, i + 1), F.get(m, i), F.get(m, i + 1)
                t = F.when(high == low, 0.0).otherwise(F.try_divide(target - low, high - low))
                return F.struct(*[(a[f] + (b[f] - a[f]) * t).alias(f) for f in ("x", "y", *also)])

            return let(F.least(F.size(p) - 2, F.greatest(F.lit(0), F.size(F.filter(m, lambda v: v <= target)) - 1)), between)

        return F.when(whole == 0, p).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at))

    return F.when(F.size(points) < 2, points).otherwise(let(F.struct(points.alias("p"), marks.alias("m")), along))


def useful_strokes(strokes: Column, least: int = 2, canvas: float = 224, border: float = 2) -> Column:
    """Strokes of enough points; single points only away from the border."""
    inside = lambda p: p["x"].between(border, canvas - border) & p["y"].between(border, canvas - border)
    return F.filter(strokes, lambda s: (F.size(s) >= least) | ((F.size(s) == 1) & inside(F.get(s, F.lit(0)))))


def segment_class(angle: Column) -> Column:
    a = F.abs(angle)
    return F.when(a.between(60, 120), "vertical").when((a <= 30) | (a >= 150), "horizontal").otherwise("diagonal")


def grid_cell(x: Column, y: Column, b: Column) -> Column:
    """Numpad cell (1-9) of a point in a box, half-open cells; null outside."""
    col, row = F.floor(F.try_divide(3 * (x - b["x_min"]), box_width(b))), F.floor(F.try_divide(3 * (y - b["y_min"]), box_height(b)))
    return F.when(col.between(0, 2) & row.between(0, 2), (2 - row) * 3 + col + 1).cast("int")


def near_anchor(x: Column, y: Column, b: Column, region: int, tolerance: float = 0.2) -> Column:
    ax, ay = ANCHORS[region]
    return (F.abs(F.try_divide(x - b["x_min"], box_width(b)) - ax) <= tolerance) & (F.abs(F.try_divide(y - b["y_min"], box_height(b)) - ay) <= tolerance)


def cell_centre(region: Column, b: Column) -> Column:
    col, row = (region - 1) % 3, 2 - F.floor((region - 1) / 3)
    return point(b["x_min"] + box_width(b) * (col + 0.5) / 3, b["y_min"] + box_height(b) * (row + 0.5) / 3)


def anchor_point(region: Column, b: Column) -> Column:
    col, row = (region - 1) % 3, 2 - F.floor((region - 1) / 3)
    return point(b["x_min"] + box_width(b) * col / 2, b["y_min"] + box_height(b) * row / 2)


def grid_direction(a: Column, b: Column, vertical_wins: bool = False) -> Column:
    """Direction from a cell to another along the longer axis; of equal axes null, or the vertical one."""
    rows, cols = F.floor((b - 1) / 3) - F.floor((a - 1) / 3), (b - 1) % 3 - (a - 1) % 3
    upright = F.abs(rows) >= F.abs(cols) if vertical_wins else F.abs(rows) > F.abs(cols)
    level = F.abs(cols) > F.abs(rows)
    out = F.when(upright & (rows > 0), "up").when(upright & (rows < 0), "down")
    return out.when(F.lit(vertical_wins) | level, F.when(cols > 0, "right").when(cols < 0, "left"))


def waypoint(item: Column) -> Column:
    """An item of a stroke template: kind (point, vertex, curve, crossing) and region, or a hint; null if neither."""
    kinds = F.create_map(*[F.lit(v) for kv in (("", "point"), ("v", "vertex"), ("c", "curve"), ("i", "crossing")) for v in kv])
    hit = item.rlike(r"^(\d|[vci]\(\d\))$")
    return F.when(hit, F.struct(F.element_at(kinds, F.regexp_extract(item, "^([vci]?)", 1)).alias("kind"), F.regexp_extract(item, r"(\d)", 1).cast("int").alias("region"), F.lit(None).cast("string").alias("hint"))).when(
        item.isin("down", "up", "left", "right", "straight"), F.struct(F.lit("hint").alias("kind"), F.lit(None).cast("int").alias("region"), item.alias("hint"))
    )


def template_segments(items: Column) -> tuple[Column, Column]:
    """Waypoints of a template, and for each segment between them the hints said since the waypoint before."""
    parsed = F.filter(F.transform(items, waypoint), lambda w: w.isNotNull())
    ways = F.filter(parsed, lambda w: w["kind"] != "hint")

    def hints(k: Column) -> Column:
        placed = F.filter(F.transform(parsed, lambda w, i: F.when(w["kind"] != "hint", i)), lambda i: i.isNotNull())
        low, high = F.when(k == 0, F.lit(-1)).otherwise(F.get(placed, k)), F.get(placed, k + 1)
        return F.transform(F.filter(parsed, lambda w, i: (w["kind"] == "hint") & (i > low) & (i < high)), lambda w: w["hint"])

    return ways, F.when(F.size(ways) < 2, F.array().cast("array<array<string>>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(ways) - 2), hints))


def mapped(strokes: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(strokes, f)
