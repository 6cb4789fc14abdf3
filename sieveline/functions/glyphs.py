"""Numpy functions on glyph masks and strokes, and pandas UDFs around them.

A mask travels as binary (one byte a pixel, row by row) with its width. Rendering, recognition
and vectorisation models are hooks: functions that a user registers by name, and that
:func:`call_hook` runs on the rows of a frame, each failure reported in its row.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: name -> function of external models (render, recognise, classify, vectorise, ...), and the type of its answers.
HOOKS: dict[str, tuple[Callable, str]] = {}


def register_hook(name: str, function: Callable, returns: str = "string") -> None:
    """A function of column values whose answers have the type ``returns`` (DDL); it is sent to the executors."""
    HOOKS[name] = function, returns


def call_hook(df: DataFrame, name: str, columns: Sequence[str], value: str = "value", error: str = "error") -> DataFrame:
    """The rows with the hook's answer, or null and the error text where it raises."""
    from ..session import ship

    if name not in HOOKS:
        raise ValueError(f"no hook {name}; registered: {sorted(HOOKS)}")
    ship(df.sparkSession)
    function, returns = HOOKS[name]
    kept = df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            answers, errors = [], []
            for args in f[list(columns)].itertuples(index=False):
                try:
                    answers.append(function(*args))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  reported in the row
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield f.assign(**{value: pd.Series(answers, index=f.index, dtype=object), error: errors})[[*kept, value, error]]

    return df.mapInPandas(run, ", ".join([*(f"`{c.name}` {c.dataType.simpleString()}" for c in df.schema), f"`{value}` {returns}", f"`{error}` string"]))

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
METRICS = T.StructType([T.StructField("shapes", T.IntegerType()), T.StructField("width", T.DoubleType()), T.StructField("hole", T.BooleanType()), T.StructField("ink", T.DoubleType())])


def mask_of(data: bytes | None, width: int) -> np.ndarray:
    a = np.frombuffer(data or b"", np.uint8)
    return a.reshape(-1, max(1, width)) > 0


def labelled(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """Component numbers (from 1; 0 outside) and their count, by union of runs."""
    height, width = mask.shape
    labels, parent = np.zeros(mask.shape, np.int32), [0]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    reach = 1 if diagonal else 0
    for y in range(height):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask[y].astype(np.int8), [0]])))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            above = np.unique(labels[y - 1, max(0, a - reach) : b + reach]) if y else np.zeros(0, np.int32)
            roots = sorted({root(int(k)) for k in above if k})
            if roots:
                for r in roots[1:]:
                    parent[r] = roots[0]
                labels[y, a:b] = roots[0]
            else:
                parent.append(len(parent))
                labels[y, a:b] = len(parent) - 1
    final = {r: i + 1 for i, r in enumerate(sorted({root(i) for i in range(1, len(parent))}))}
    table = np.array([0] + [final[root(i)] for i in range(1, len(parent))], np.int32)
    return table[labels], len(final)


def shape_metrics(mask: np.ndarray) -> tuple[int, float]:
    """Number of shapes, and the widest one's share of the width."""
    labels, n = labelled(mask)
    widest = max((np.ptp(np.flatnonzero((labels == i).any(axis=0))) + 1 for i in range(1, n + 1)), default=0)
    return n, widest / mask.shape[1]


def has_hole(mask: np.ndarray) -> bool:
    """Whether the background has more than its outer part."""
    return labelled(~np.pad(mask, 1), diagonal=False)[1] > 1


def iou(a: np.ndarray, b: np.ndarray) -> float:
    union = np.logical_or(a, b).sum()
    return float(np.logical_and(a, b).sum() / union) if union else 0.0


def fitted(mask: np.ndarray, size: int) -> np.ndarray | None:
    """The inked box scaled to a square by nearest pixels."""
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return None
    part = mask[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]
    at = lambda n: (np.arange(size) * n // size).astype(int)
    return part[np.ix_(at(part.shape[0]), at(part.shape[1]))]


def distance_squared(mask: np.ndarray, reach: float = math.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squared distance of each pixel to the nearest set one, and that pixel (row, column): along columns first, then over ever wider steps along rows.

    With ``reach``, distances beyond it need not be the least ones.
    """
    height, width = mask.shape
    far = height * height + width * width + 1
    rows = np.arange(height)[:, None]
    up = np.maximum.accumulate(np.where(mask, rows, -far), axis=0)
    down = np.minimum.accumulate(np.where(mask, rows, far * 2)[::-1], axis=0)[::-1]
    nearest_row = np.where(rows - up <= down - rows, up, down)
    column = np.minimum((nearest_row - rows) ** 2, far)
    best, from_x = column.copy(), np.broadcast_to(np.arange(width), mask.shape).copy()
    for step in range(1, width):
        if step > reach or step * step > best.max():
            break
        for here, there, first in ((slice(step, None), slice(None, -step), True), (slice(None, -step), slice(step, None), False)):
            cost, at = column[:, there] + step * step, np.arange(width)[there][None, :]
            # of equal ways the one from the left counts
            better = cost <= best[:, here] if first else cost < best[:, here]
            best[:, here] = np.where(better, cost, best[:, here])
            from_x[:, here] = np.where(better, at, from_x[:, here])
    return best, np.take_along_axis(nearest_row, from_x, 1), from_x


def snapped(points: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Points outside the mask move to its nearest pixel."""
    if not len(points) or not mask.any():
        return points
    _, ny, nx = distance_squared(mask)
    x, y = (np.clip(np.rint(points[:, i]).astype(int), 0, mask.shape[1 - i] - 1) for i in (0, 1))
    inside = mask[y, x] & (np.rint(points[:, 0]) == x) & (np.rint(points[:, 1]) == y)
    return np.where(inside[:, None], points, np.stack([nx[y, x], ny[y, x]], axis=1))


def thinned(mask: np.ndarray) -> np.ndarray:
    """One-pixel skeleton by alternate parallel thinning of the two diagonal sides; of one mask (h, w) or of many (n, h, w) at once."""
    m = np.pad(mask, [(0, 0)] * (mask.ndim - 2) + [(1, 1), (1, 1)]).astype(np.uint8)
    middle, low, high = slice(1, -1), slice(None, -2), slice(2, None)
    changed = True
    while changed:
        changed = False
        for side in (0, 1):
            n, e, s, w = m[..., low, middle], m[..., middle, high], m[..., high, middle], m[..., middle, low]
            ring = [n, m[..., low, high], e, m[..., high, high], s, m[..., high, low], w, m[..., low, low]]
            count = sum(ring[1:], ring[0])
            turns = sum(((1 - a) & b for a, b in zip(ring, ring[1:] + ring[:1], strict=True)), np.uint8(0))
            keep = (n & e & s | e & s & w) if side == 0 else (n & e & w | n & s & w)
            gone = (m[..., middle, middle] == 1) & (count >= 2) & (count <= 6) & (turns == 1) & (keep == 0)
            if gone.any():
                m[..., middle, middle][gone] = 0
                changed = True
    return m[..., middle, middle].astype(bool)


def thinned_masks(masks: Sequence[np.ndarray]) -> list[np.ndarray]:
    """The skeletons of masks, those of one shape together."""
    out: list = [None] * len(masks)
    shapes: dict[tuple[int, ...], list[int]] = {}
    for i, m in enumerate(masks):
        shapes.setdefault(m.shape, []).append(i)
    for at in shapes.values():
        for i, bones in zip(at, thinned(np.stack([masks[i] for i in at])), strict=True):
            out[i] = bones
    return out


def skeleton_graph(skeleton: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Pixel (x, y) -> its 8-neighbours on the skeleton."""
    inked = {(int(x), int(y)) for y, x in zip(*np.nonzero(skeleton), strict=True)}
    return {(x, y): [(x + dx, y + dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dx or dy) and (x + dx, y + dy) in inked] for x, y in sorted(inked)}


def traced(graph: dict[tuple[int, int], list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """Strokes of a skeleton: from each end, going straight on where the path forks, every edge once."""
    used: set[frozenset] = set()
    out = []
    for start in [p for p in graph if len(graph[p]) == 1] + list(graph):
        for first in graph[start]:
            if frozenset((start, first)) in used:
                continue
            path = [start, first]
            used.add(frozenset((start, first)))
            while True:
                a, b = path[-2], path[-1]
                ways = [q for q in graph[b] if frozenset((b, q)) not in used]
                if not ways:
                    break
                dx, dy = b[0] - a[0], b[1] - a[1]
                q = max(ways, key=lambda q: ((q[0] - b[0]) * dx + (q[1] - b[1]) * dy) / math.hypot(q[0] - b[0], q[1] - b[1]))
                used.add(frozenset((b, q)))
                path.append(q)
            out.append(path)
    return out


def pruned_spurs(strokes: list[np.ndarray], least: float) -> list[np.ndarray]:
    return [s for s in strokes if len(s) > 1 and np.hypot(*np.diff(s, axis=0).T).sum() >= least] or strokes[:1]


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Points that deviate from their chord by more than the tolerance, by a stack of spans."""
    if len(points) < 3:
        return points
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    spans = [(0, len(points) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        chord, rest = points[b] - points[a], points[a + 1 : b] - points[a]
        n = math.hypot(*chord)
        off = np.abs(chord[0] * rest[:, 1] - chord[1] * rest[:, 0]) / n if n else np.hypot(*rest.T)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            spans += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def line_pixels(x0: int, y0: int, x1: int, y1: int) -> list[tuple[int, int]]:
    """Pixels of a line, by integer error steps."""
    dx, dy, sx, sy = abs(x1 - x0), -abs(y1 - y0), 1 if x0 < x1 else -1, 1 if y0 < y1 else -1
    error, out = dx + dy, [(x0, y0)]
    while (x0, y0) != (x1, y1):
        twice = 2 * error
        if twice >= dy:
            error, x0 = error + dy, x0 + sx
        if twice <= dx:
            error, y0 = error + dx, y0 + sy
        out.append((x0, y0))
    return out


def spline_smoothed(points: np.ndarray, n: int) -> np.ndarray:
    """``n`` points of the uniform cubic B-spline with clamped ends."""
    if len(points) < 3:
        return points
    p = np.vstack([points[:1], points[:1], points, points[-1:], points[-1:]])
    t = np.linspace(0, len(p) - 3 - 1e-9, n)
    i, u = t.astype(int), (t - t.astype(int))[:, None]
    return ((1 - u) ** 3 * p[i] + (3 * u**3 - 6 * u**2 + 4) * p[i + 1] + (-3 * u**3 + 3 * u**2 + 3 * u + 1) * p[i + 2] + u**3 * p[i + 3]) / 6


def smoothed_locked(points: list[list[float]], rounds: int = 1) -> list[list[float]]:
    """Each inner point moves to the mean of itself and its neighbours; ends and points marked [x, y, 1] stay."""
    for _ in range(rounds):
        old = [list(p) for p in points]
        for i in range(1, len(points) - 1):
            if len(points[i]) < 3 or not points[i][2]:
                points[i] = [(old[i - 1][k] + old[i][k] + old[i + 1][k]) / 3 for k in (0, 1)] + points[i][2:]
    return points


def centred_by_rays(points: np.ndarray, mask: np.ndarray, directions: int = 36) -> np.ndarray:
    """Each point inside the mask moves to the middle of the shortest line across the mask through it; all points and lines go a step further at once."""
    out = points.astype(float).copy()
    height, width = mask.shape
    angles = [math.pi * d / (directions // 2) for d in range(directions // 2)]
    cos, sin = np.array([math.cos(a) for a in angles]), np.array([math.sin(a) for a in angles])

    def inside(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        i, j = np.rint(x).astype(int), np.rint(y).astype(int)
        on = (i >= 0) & (i < width) & (j >= 0) & (j < height)
        on[on] = mask[j[on], i[on]]
        return on

    at = np.flatnonzero(inside(out[:, 0], out[:, 1]))
    if not len(at) or not len(angles):
        return out
    steps = np.zeros((len(at), len(angles), 2), int)
    point, line, way = (v.reshape(-1) for v in np.indices(steps.shape))
    r = 0
    while len(point):
        r += 1
        sign = r * (1 - 2 * way)
        on = inside(out[at[point], 0] + sign * cos[line], out[at[point], 1] + sign * sin[line])
        point, line, way = point[on], line[on], way[on]
        steps[point, line, way] = r
    best = steps.sum(axis=2).argmin(axis=1)
    ends = steps[np.arange(len(at)), best]
    shift = (ends[:, 0] - ends[:, 1]) / 2
    out[at] += np.stack([shift * cos[best], shift * sin[best]], axis=1)
    return out


def near_share(mask: np.ndarray, points: np.ndarray, reach: float = 6.0) -> float:
    """Share of the mask's pixels within ``reach`` of a point."""
    if not mask.any() or not len(points):
        return 0.0
    dots = np.zeros_like(mask)
    x, y = (np.clip(np.rint(points[:, i]).astype(int), 0, mask.shape[1 - i] - 1) for i in (0, 1))
    dots[y, x] = True
    return float((distance_squared(dots, reach)[0][mask] <= reach * reach).mean())


def direction_at(stroke: np.ndarray, end: int, n: int = 5) -> np.ndarray:
    """Unit vector out of a stroke's start (0) or end (1), from its last ``n`` points."""
    part = stroke[:n][::-1] if end == 0 else stroke[-n:]
    v = part[-1] - part[0]
    length = math.hypot(*v)
    return v / length if length else np.zeros(2)


def merged(strokes: list[np.ndarray], reach: float = 3.0, most_degrees: float = 45.0, stub: float = 18.0) -> list[np.ndarray]:
    """Strokes that meet end to end and go on straight are joined, straightest first, until none is left; then stubs that touch another stroke's end are absorbed, and stubs that touch nothing go."""
    strokes = [np.asarray(s, float) for s in strokes if len(s)]
    while True:
        best = None
        for i in range(len(strokes)):
            for j in range(i + 1, len(strokes)):
                for a in (0, 1):
                    for b in (0, 1):
                        if math.dist(strokes[i][-a], strokes[j][-b]) <= reach:
                            turn = math.degrees(math.acos(max(-1.0, min(1.0, float(-direction_at(strokes[i], a) @ direction_at(strokes[j], b))))))
                            if turn <= most_degrees and (best is None or turn < best[0]):
                                best = turn, i, j, a, b
        if best is None:
            break
        _, i, j, a, b = best
        first = strokes[i] if a == 1 else strokes[i][::-1]
        second = strokes[j] if b == 0 else strokes[j][::-1]
        strokes = [s for k, s in enumerate(strokes) if k not in (i, j)] + [np.vstack([first, second])]
    size = lambda s: float(np.hypot(*np.diff(s, axis=0).T).sum()) if len(s) > 1 else 0.0
    out = [s for s in strokes if size(s) >= stub]
    if not out:
        return strokes
    for s in strokes:
        if size(s) < stub:
            for k, o in enumerate(out):
                if math.dist(o[-1], s[0]) <= reach:
                    out[k] = np.vstack([o, s])
                    break
                if math.dist(o[-1], s[-1]) <= reach:
                    out[k] = np.vstack([o, s[::-1]])
                    break
    return out


_TOKEN = re.compile(r"([MmLlHhVvCcSsQqTtAaZz])|([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)")
_ARITY = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}


def svg_path(d: str | None, samples: int = 10) -> list[list[tuple[float, float]]]:
    """Strokes of an SVG path: all commands, relative and absolute; curves are sampled, arcs go by their end points' ellipse."""
    strokes: list[list[tuple[float, float]]] = []
    at = start = (0.0, 0.0)
    command, numbers, last, control = "", [], "", None

    def curve(ps: list[tuple[float, float]]) -> None:
        n = len(ps) - 1
        for k in range(1, samples + 1):
            t = k / samples
            strokes[-1].append(tuple(sum(math.comb(n, i) * (1 - t) ** (n - i) * t**i * p[axis] for i, p in enumerate(ps)) for axis in (0, 1)))

    def arc(rx: float, ry: float, turn: float, large: bool, sweep: bool, end: tuple[float, float]) -> None:
        if not rx or not ry or end == at:
            strokes[-1].append(end)
            return
        rx, ry, phi = abs(rx), abs(ry), math.radians(turn)
        c, s = math.cos(phi), math.sin(phi)
        hx, hy = (at[0] - end[0]) / 2, (at[1] - end[1]) / 2
        x, y = c * hx + s * hy, c * hy - s * hx
        grow = math.sqrt(max(1.0, x * x / rx / rx + y * y / ry / ry))
        rx, ry = rx * grow, ry * grow
        k = math.sqrt(max(0.0, (rx * rx * ry * ry - rx * rx * y * y - ry * ry * x * x) / (rx * rx * y * y + ry * ry * x * x))) * (-1 if large == sweep else 1)
        cx, cy = k * rx * y / ry, -k * ry * x / rx
        a0 = math.atan2((y - cy) / ry, (x - cx) / rx)
        span = math.atan2((-y - cy) / ry, (-x - cx) / rx) - a0
        span += math.tau if sweep and span < 0 else -math.tau if not sweep and span > 0 else 0
        mx, my = (at[0] + end[0]) / 2, (at[1] + end[1]) / 2
        for i in range(1, samples + 1):
            a = a0 + span * i / samples
            ex, ey = rx * math.cos(a) + cx, ry * math.sin(a) + cy
            strokes[-1].append((c * ex - s * ey + mx, s * ex + c * ey + my))

    def act() -> None:
        nonlocal at, start, command, last, control
        big, n = command.upper(), list(numbers)
        ox, oy = at if command.islower() else (0.0, 0.0)
        if big == "Z":
            if strokes and strokes[-1]:
                strokes[-1].append(start)
            at = start
        elif big == "M":
            at = start = n[0] + ox, n[1] + oy
            strokes.append([at])
            command = "l" if command == "m" else "L"
        else:
            if not strokes:
                strokes.append([at])
            elif last == "Z":
                strokes.append([at])
            if big in "HV":
                end = (n[0] + ox, at[1]) if big == "H" else (at[0], n[0] + oy)
                strokes[-1].append(end)
            elif big == "A":
                end = n[5] + ox, n[6] + oy
                arc(n[0], n[1], n[2], bool(n[3]), bool(n[4]), end)
            else:
                ps = [(n[i] + ox, n[i + 1] + oy) for i in range(0, len(n), 2)]
                if big in "ST":
                    smooth = last in ("CS" if big == "S" else "QT") and control is not None
                    ps.insert(0, (2 * at[0] - control[0], 2 * at[1] - control[1]) if smooth else at)
                end = ps[-1]
                if len(ps) == 1:
                    strokes[-1].append(end)
                else:
                    curve([at, *ps])
                    control = ps[-2]
            at = end
        last = big
        numbers.clear()

    for m in _TOKEN.finditer(d or ""):
        if m[1]:
            command = m[1]
            numbers.clear()
            if command in "Zz":
                act()
        elif command and command not in "Zz":
            numbers.append(float(m[2]))
            if len(numbers) == _ARITY[command.upper()]:
                act()
    return strokes


@F.pandas_udf(T.ArrayType(T.ArrayType(POINT)))
def svg_strokes(d: pd.Series) -> pd.Series:
    return pd.Series([[[{"x": x, "y": y} for x, y in s] for s in svg_path(p)] for p in d])


@F.pandas_udf(METRICS)
def mask_metrics(mask: pd.Series, width: pd.Series) -> pd.DataFrame:
    rows = []
    for data, w in zip(mask, width, strict=True):
        m = mask_of(data, w)
        n, share = shape_metrics(m)
        rows.append((n, share, has_hole(m), float(m.mean()) if m.size else 0.0))
    return pd.DataFrame(rows, columns=["shapes", "width", "hole", "ink"])


def _points(values) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in values], float).reshape(-1, 2)


@F.pandas_udf(T.ArrayType(POINT))
def simplify(points: pd.Series, tolerance: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else [{"x": x, "y": y} for x, y in simplified(_points(p), t)] for p, t in zip(points, tolerance, strict=True)])


def _moved(function: Callable[..., np.ndarray], mask: pa.Array, width: pa.Array, points: pa.Array, *more: pa.Array) -> pa.Array:
    """The points of each row where ``function`` (points, mask, ...) puts them; points stay in Arrow's columns and are never objects. Null of no points."""
    flat = points.flatten()
    xy = np.stack([pc.cast(flat.field(c), pa.float64()).to_numpy(zero_copy_only=False) for c in ("x", "y")], axis=1)
    counts = pc.fill_null(pc.list_value_length(points), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(counts)])
    out = [function(xy[a:b], mask_of(m, w), *o) for m, w, a, b, *o in zip(mask.to_pylist(), width.to_pylist(), ends[:-1], ends[1:], *(v.to_pylist() for v in more), strict=True)]
    xy = np.concatenate(out).astype(float) if out else np.zeros((0, 2))
    of = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], names=["x", "y"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), of, mask=points.is_null() if points.null_count else None)


@F.arrow_udf(T.ArrayType(POINT))
def snap(mask: pa.Array, width: pa.Array, points: pa.Array) -> pa.Array:
    """Points outside the mask at its nearest pixels."""
    return _moved(snapped, mask, width, points)


@F.arrow_udf(T.ArrayType(POINT))
def snap_near(mask: pa.Array, width: pa.Array, points: pa.Array, reach: pa.Array) -> pa.Array:
    """Points within reach of the mask at its nearest pixels; others as they are."""
    return _moved(snapped_within, mask, width, points, reach)


@F.pandas_udf(T.ArrayType(T.ArrayType(POINT)))
def trace(mask: pd.Series, width: pd.Series) -> pd.Series:
    """The strokes of a mask taken as a skeleton."""
    return pd.Series([[[{"x": float(x), "y": float(y)} for x, y in s] for s in traced(skeleton_graph(mask_of(m, w)))] for m, w in zip(mask, width, strict=True)])


@F.pandas_udf(T.StructType([T.StructField("points", T.IntegerType()), T.StructField("edges", T.IntegerType()), T.StructField("ends", T.IntegerType()), T.StructField("junctions", T.IntegerType())]))
def graph_counts(mask: pd.Series, width: pd.Series) -> pd.DataFrame:
    """Pixels, links, ends and junctions of a mask taken as a skeleton."""
    rows = []
    for m, w in zip(mask, width, strict=True):
        degrees = [len(v) for v in skeleton_graph(mask_of(m, w)).values()]
        rows.append((len(degrees), sum(degrees) // 2, degrees.count(1), sum(d >= 3 for d in degrees)))
    return pd.DataFrame(rows, columns=["points", "edges", "ends", "junctions"])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def line(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    """Pixels of a line as x, y, x, y, ..."""
    return pd.Series([[v for p in line_pixels(*ends) for v in p] for ends in zip(x0, y0, x1, y1, strict=True)])


@F.pandas_udf(T.ArrayType(POINT))
def smooth(points: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else [{"x": x, "y": y} for x, y in spline_smoothed(_points(p), k)] for p, k in zip(points, n, strict=True)])


@F.pandas_udf(T.DoubleType())
def fitted_iou(a: pd.Series, b: pd.Series, width: pd.Series, size: pd.Series) -> pd.Series:
    """Overlap of two masks, each scaled from its inked box to a square; null where one is empty."""
    out = []
    for x, y, w, n in zip(a, b, width, size, strict=True):
        p, q = fitted(mask_of(x, w), n), fitted(mask_of(y, w), n)
        out.append(None if p is None or q is None else iou(p, q))
    return pd.Series(out, dtype="float64")


def case_mismatches(letters: DataFrame, threshold: float = 0.75, size: int = 64) -> DataFrame:
    """asset, letters whose two cases look alike though they should not: rows are (asset, letter, lower, upper, width)."""
    from .text import CASE_SYMMETRIC

    alike = letters.where(~F.col("letter").isin(*CASE_SYMMETRIC)).select("asset", "letter", fitted_iou("lower", "upper", "width", F.lit(size)).alias("iou"))
    return alike.groupBy("asset").agg(F.array_sort(F.collect_list(F.when(F.col("iou") >= threshold, F.col("letter")))).alias("letters"))


@F.arrow_udf(T.ArrayType(POINT))
def centre_by_rays(mask: pa.Array, width: pa.Array, points: pa.Array) -> pa.Array:
    return _moved(centred_by_rays, mask, width, points)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def smooth_locked(points: pd.Series, rounds: pd.Series) -> pd.Series:
    return pd.Series([smoothed_locked([list(map(float, q)) for q in p], int(r)) for p, r in zip(points, rounds, strict=True)])


@F.pandas_udf(T.StructType([T.StructField("ridge_pixels", T.IntegerType()), T.StructField("n_strokes", T.IntegerType()), T.StructField("deepest", T.DoubleType())]))
def ridge_counts(mask: pd.Series, width: pd.Series, kind: pd.Series) -> pd.DataFrame:
    rows = []
    for m, w, k in zip(mask, width, kind, strict=True):
        line_, depth = ridge(mask_of(m, w), k, 1.0)
        rows.append((int(line_.sum()), len(ridge_strokes(line_, depth, 2)), float(depth[line_].max()) if line_.any() else 0.0))
    return pd.DataFrame(rows, columns=["ridge_pixels", "n_strokes", "deepest"])


@F.pandas_udf(T.DoubleType())
def ink_share(mask: pd.Series, width: pd.Series) -> pd.Series:
    """``mask_metrics``' ink alone, without looking for shapes and holes."""
    masks = (mask_of(m, w) for m, w in zip(mask, width, strict=True))
    return pd.Series([float(m.mean()) if m.size else 0.0 for m in masks], dtype=float)


RIDGES = ("crest", "curve", "slope")
_COUNTS = T.StructType([T.StructField("ridge_pixels", T.IntegerType()), T.StructField("n_strokes", T.IntegerType()), T.StructField("deepest", T.DoubleType())])


@F.pandas_udf(T.StructType([T.StructField(k, _COUNTS) for k in RIDGES]))
def all_ridge_counts(mask: pd.Series, width: pd.Series) -> pd.DataFrame:
    """``ridge_counts`` of each kind: a mask's depths are found once, the lines of a batch are thinned together."""
    masks = [mask_of(m, w) for m, w in zip(mask, width, strict=True)]
    depths = [ridge_depth(m) for m in masks]
    out = {}
    for kind in RIDGES:
        lines = thinned_masks([ridge_pixels(m, d, kind, 1.0) for m, d in zip(masks, depths, strict=True)])
        out[kind] = [{"ridge_pixels": int(v.sum()), "n_strokes": len(ridge_strokes(v, d, 2)), "deepest": float(d[v].max()) if v.any() else 0.0} for v, d in zip(lines, depths, strict=True)]
    return pd.DataFrame(out, columns=RIDGES)


@F.pandas_udf(T.StructType([T.StructField("skeleton", T.IntegerType()), T.StructField("pruned", T.IntegerType()), T.StructField("n_strokes", T.IntegerType()), T.StructField("fitted", T.IntegerType()), T.StructField("segments", T.IntegerType())]))
def skeleton_summary(mask: pd.Series, width: pd.Series) -> pd.DataFrame:
    """What the skeleton of a mask comes to: pixels, pixels without spurs, strokes, strokes by curves, and paths between junctions."""
    rows = []
    for bones in thinned_masks([mask_of(m, w) for m, w in zip(mask, width, strict=True)]):
        graph = skeleton_graph(bones)
        strokes = traced(graph)
        rows.append((int(bones.sum()), int(without_spurs(bones, 2).sum()), len(strokes), len(smoothed(strokes, 1.0)), len(segments_of(bones, graph))))
    return pd.DataFrame(rows, columns=["skeleton", "pruned", "n_strokes", "fitted", "segments"])


def segments_of(skeleton: np.ndarray, graph: dict[tuple[int, int], list[tuple[int, int]]] | None = None) -> list[list[tuple[int, int]]]:
    """Paths of a skeleton from end or junction to end or junction, and its rings."""
    graph = skeleton_graph(skeleton) if graph is None else graph
    stops, used, out = {p for p, n in graph.items() if len(n) != 2}, set(), []
    for start in [*sorted(stops), *graph]:
        for first in graph[start]:
            if frozenset((start, first)) in used:
                continue
            path = [start, first]
            used.add(frozenset(path))
            while path[-1] not in stops and path[-1] != start:
                onward = [q for q in graph[path[-1]] if frozenset((path[-1], q)) not in used]
                if not onward:
                    break
                used.add(frozenset((path[-1], onward[0])))
                path.append(onward[0])
            out.append(path)
    return out


@F.pandas_udf(T.IntegerType())
def cluster_count(mask: pd.Series, width: pd.Series, apart: pd.Series) -> pd.Series:
    """Groups of a mask's pixels, taken as junctions."""
    from .strokes import cluster_junctions

    return pd.Series([len(cluster_junctions([(int(x), int(y)) for y, x in zip(*np.nonzero(mask_of(m, w)))], a)) for m, w, a in zip(mask, width, apart, strict=True)])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def joined_sizes(points: pd.Series, size: pd.Series, count: pd.Series) -> pd.Series:
    """Sizes of the strokes that pieces of ``size`` points become when joined to ``count``."""
    from .strokes import Glyph

    return pd.Series([[len(s) for s in Glyph([_points(p)[i : i + k] for i in range(0, len(p), k)]).to_count([n]).strokes] for p, k, n in zip(points, size, count, strict=True)])


@F.pandas_udf(T.IntegerType())
def segment_edges(mask: pd.Series, width: pd.Series) -> pd.Series:
    """Edges in all segments of a mask taken as a skeleton, each counted once."""
    return pd.Series([len({frozenset(e) for s in segments_of(mask_of(m, w)) for e in zip(s, s[1:])}) for m, w in zip(mask, width, strict=True)])


@F.pandas_udf(T.DoubleType())
def vertex_sum(mask: pd.Series, width: pd.Series) -> pd.Series:
    """The vertices of a mask as one number: regions times places."""
    return pd.Series([float(sum(r * (x + w * y) for r, (x, y) in vertices(mask_of(m, w)).items())) for m, w in zip(mask, width, strict=True)])


@F.pandas_udf(POINT)
def bowl_minimum(x: pd.Series, y: pd.Series) -> pd.DataFrame:
    """The minimum within the unit square around 0 of a bowl around (x, y), by search: all rows of a batch at once."""
    a, b = x.to_numpy(float), y.to_numpy(float)
    out = chained_all(lambda p: (p[:, 0] - a) ** 2 + (p[:, 1] - b) ** 2, [(-1.0, 1.0)] * 2, np.zeros((len(a), 2)))[0]
    return pd.DataFrame(out, columns=["x", "y"])


@F.pandas_udf(T.DoubleType())
def stroke_share(mask: pd.Series, width: pd.Series, points: pd.Series) -> pd.Series:
    return pd.Series([near_share(mask_of(m, w), _points(p)) for m, w, p in zip(mask, width, points, strict=True)])


def cloud_points(pixels: DataFrame, stride: int = 2) -> DataFrame:
    """Pixels on the stride's grid."""
    return pixels.where((F.col("x") % stride == 0) & (F.col("y") % stride == 0))


def centred_on(points: Column, box: Column) -> Column:
    """Points shifted so that the centre of their box is that of ``box``."""
    from .points import add, box as box_of, box_centre, subtract

    shift = subtract(box_centre(box), box_centre(box_of(points)))
    return F.transform(points, lambda p: add(p, shift))


def per_glyph(df: DataFrame, group: str, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A Python function on the rows of each glyph; a glyph is bounded by its canvas."""
    from ..session import ship

    ship(df.sparkSession)
    return df.groupBy(group).applyInPandas(function, schema)


def simplex_step(f: Callable[[np.ndarray], float], simplex: list[np.ndarray], values: list[float]) -> tuple[list[np.ndarray], list[float]]:
    """A round of downhill simplex: reflect, expand, contract or shrink."""
    order = np.argsort(values, kind="stable")
    simplex, values = [simplex[i] for i in order], [values[i] for i in order]
    centre = np.mean(simplex[:-1], axis=0)
    tried = {k: centre + k * (simplex[-1] - centre) for k in (-1.0, -2.0, 0.5)}
    reflected = f(tried[-1.0])
    if reflected < values[0]:
        expanded = f(tried[-2.0])
        k, v = (-2.0, expanded) if expanded < reflected else (-1.0, reflected)
    elif reflected < values[-2]:
        k, v = -1.0, reflected
    else:
        k, v = 0.5, f(tried[0.5])
    if v < values[-1]:
        return [*simplex[:-1], tried[k]], [*values[:-1], v]
    simplex = [simplex[0]] + [(p + simplex[0]) / 2 for p in simplex[1:]]
    return simplex, [values[0]] + [f(p) for p in simplex[1:]]


def minimised(f: Callable[[np.ndarray], float], start: np.ndarray, steps: int = 200, size: float = 1.0) -> tuple[np.ndarray, float]:
    """Downhill simplex from ``start``."""
    n = len(start)
    simplex = [np.asarray(start, float)] + [np.asarray(start, float) + size * np.eye(n)[i] for i in range(n)]
    values = [f(p) for p in simplex]
    for _ in range(steps):
        simplex, values = simplex_step(f, simplex, values)
    k = int(np.argmin(values))
    return simplex[k], float(values[k])


def phases(frames: Iterator[tuple[str, float]]) -> Iterator[tuple[str, float, float]]:
    """phase, score and best score so far of an optimisation's frames; higher is better."""
    best = -math.inf
    for phase, score in frames:
        best = max(best, score)
        yield phase, score, best


def generation_step(f: Callable[[np.ndarray], float], people: np.ndarray, values: np.ndarray, low: np.ndarray, high: np.ndarray, rng: np.random.Generator) -> None:
    """A generation, in place: each member tries the best plus the difference of two others."""
    for i in range(len(people)):
        a, b = people[rng.choice(len(people), 2, replace=False)]
        trial = np.clip(people[values.argmin()] + 0.7 * (a - b), low, high)
        trial = np.where(rng.random(len(low)) < 0.9, trial, people[i])
        if (v := f(trial)) <= values[i]:
            people[i], values[i] = trial, v


def differential_evolution(f: Callable[[np.ndarray], float], bounds: list[tuple[float, float]], rounds: int = 60, size: int = 20, seed: int = 0) -> tuple[np.ndarray, float]:
    """Best point of a population that moves by differences of its members; the same for the same seed."""
    rng, low, high = np.random.default_rng(seed), *np.array(bounds, float).T
    people = low + rng.random((size, len(low))) * (high - low)
    values = np.array([f(p) for p in people])
    for _ in range(rounds):
        generation_step(f, people, values, low, high, rng)
    return people[values.argmin()], float(values.min())


def chained(f: Callable[[np.ndarray], float], bounds: list[tuple[float, float]], start: np.ndarray, seed: int = 0) -> tuple[np.ndarray, float]:
    """Downhill simplex, then the population search, then the simplex from what is better; clipped to the bounds."""
    low, high = np.array(bounds, float).T

    def within(p: np.ndarray) -> float:
        inside = np.clip(p, low, high)
        return f(inside) + float(((p - inside) ** 2).sum())

    reach = float(np.mean(high - low)) / 10
    best = min((minimised(within, start, size=reach), differential_evolution(f, bounds, seed=seed)), key=lambda r: r[1])
    last = minimised(within, best[0], size=reach / 2)
    point, value = min((best, last), key=lambda r: r[1])
    return np.clip(point, low, high), value


def minimised_all(f: Callable[[np.ndarray], np.ndarray], starts: np.ndarray, steps: int = 200, size: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """:func:`minimised` for many rows at once: ``f`` takes a point (a row of an array) for each row and gives its values."""
    n = starts.shape[1]
    simplex = np.stack([starts, *[starts + size * np.eye(n)[i] for i in range(n)]], axis=1).astype(float)
    values = np.stack([f(simplex[:, i]) for i in range(n + 1)], axis=1)
    for _ in range(steps):
        order = np.argsort(values, axis=1, kind="stable")
        simplex, values = np.take_along_axis(simplex, order[:, :, None], axis=1), np.take_along_axis(values, order, axis=1)
        centre = simplex[:, :-1].mean(axis=1)
        at = lambda k: centre + k * (simplex[:, -1] - centre)  # noqa: E731, B023
        (reflected, r), (expanded, e), (inner, i) = ((p := at(k), f(p)) for k in (-1.0, -2.0, 0.5))
        top, good = r < values[:, 0], r < values[:, -2]
        further = top & (e < r)
        point = np.where(further[:, None], expanded, np.where((top | good)[:, None], reflected, inner))
        value = np.where(further, e, np.where(top | good, r, i))
        better = value < values[:, -1]
        simplex[better, -1], values[better, -1] = point[better], value[better]
        for k in range(1, n + 1):
            halved = (simplex[:, k] + simplex[:, 0]) / 2
            simplex[:, k] = np.where(better[:, None], simplex[:, k], halved)
            values[:, k] = np.where(better, values[:, k], f(halved))
    k, rows = values.argmin(axis=1), np.arange(len(values))
    return simplex[rows, k], values[rows, k]


def evolved_all(f: Callable[[np.ndarray], np.ndarray], bounds: list[tuple[float, float]], rows: int, rounds: int = 60, size: int = 20, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """:func:`differential_evolution` for many rows at once, each with the draws that it would have alone."""
    rng, low, high = np.random.default_rng(seed), *np.array(bounds, float).T
    people = np.repeat((low + rng.random((size, len(low))) * (high - low))[None], rows, axis=0)
    values, each = np.stack([f(people[:, i]) for i in range(size)], axis=1), np.arange(rows)
    for _ in range(rounds):
        for i in range(size):
            a, b = rng.choice(size, 2, replace=False)
            trial = np.clip(people[each, values.argmin(axis=1)] + 0.7 * (people[:, a] - people[:, b]), low, high)
            trial = np.where(rng.random(len(low)) < 0.9, trial, people[:, i])
            v = f(trial)
            better = v <= values[:, i]
            people[better, i], values[better, i] = trial[better], v[better]
    k = values.argmin(axis=1)
    return people[each, k], values[each, k]


def chained_all(f: Callable[[np.ndarray], np.ndarray], bounds: list[tuple[float, float]], starts: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """:func:`chained` for many rows at once, with the same results; ``f`` takes a point for each row and gives its values."""
    low, high = np.array(bounds, float).T

    def within(p: np.ndarray) -> np.ndarray:
        inside = np.clip(p, low, high)
        return f(inside) + ((p - inside) ** 2).sum(axis=1)

    def lower(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
        first = ~(b[1] < a[1])
        return np.where(first[:, None], a[0], b[0]), np.where(first, a[1], b[1])

    reach = float(np.mean(high - low)) / 10
    best = lower(minimised_all(within, starts, size=reach), evolved_all(f, bounds, len(starts), seed=seed))
    point, value = lower(best, minimised_all(within, best[0], size=reach / 2))
    return np.clip(point, low, high), value


def snapped_within(points: np.ndarray, mask: np.ndarray, reach: float = 15.0) -> np.ndarray:
    """Points on the canvas move to the nearest pixel of the mask, if it is within reach; others stay."""
    if not len(points) or not mask.any():
        return points
    far, ny, nx = distance_squared(mask)
    x, y = (np.rint(points[:, i]).astype(int) for i in (0, 1))
    on = (x >= 0) & (x < mask.shape[1]) & (y >= 0) & (y < mask.shape[0])
    x, y = np.where(on, x, 0), np.where(on, y, 0)
    near = on & (far[y, x] <= reach * reach)
    return np.where(near[:, None], np.stack([nx[y, x], ny[y, x]], axis=1), points)


def neighbours(skeleton: np.ndarray) -> np.ndarray:
    """Number of set 8-neighbours of each pixel."""
    m = np.pad(skeleton.astype(np.int16), 1)
    h, w = skeleton.shape
    return sum(m[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3) if (dy, dx) != (1, 1))


def without_spurs(skeleton: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Ends are taken off, a pixel at a time; whole branches up to that length go, longer ones get shorter."""
    out = skeleton.astype(bool)
    for _ in range(rounds):
        ends = out & (neighbours(out) == 1)
        if not ends.any():
            break
        out = out & ~ends
    return out


def ridge_depth(mask: np.ndarray) -> np.ndarray:
    """The distance of each pixel to the nearest one outside the mask."""
    return np.sqrt(distance_squared(~mask)[0].astype(float)) if not mask.all() else np.full(mask.shape, np.inf)


def ridge_pixels(mask: np.ndarray, depth: np.ndarray, kind: str, least: float) -> np.ndarray:
    """Where the depth is a crest in some direction, where it curves down, or where its slopes run together."""
    if kind == "crest":
        shift = lambda dy, dx: np.roll(depth, (dy, dx), (0, 1))
        found = np.zeros_like(mask)
        for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1)):
            found |= (depth >= shift(dy, dx)) & (depth >= shift(-dy, -dx))
    elif kind == "curve":
        p = np.pad(depth, 1, mode="symmetric")
        found = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * depth < -0.5
    else:
        gy, gx = np.gradient(depth)
        size = np.hypot(gx, gy) + 1e-10
        found = np.gradient(gx / size, axis=1) + np.gradient(gy / size, axis=0) < -0.7
    return found & mask & (depth >= least)


def ridge(mask: np.ndarray, kind: str = "crest", least: float = 1.5) -> tuple[np.ndarray, np.ndarray]:
    """Thinned centre line and depth of a mask."""
    depth = ridge_depth(mask)
    found = ridge_pixels(mask, depth, kind, least)
    return thinned(found) if found.any() else found, depth


def ridge_strokes(line: np.ndarray, depth: np.ndarray, least: int = 5) -> list[list[tuple[float, float, float]]]:
    """(x, y, half width) along the paths of a centre line."""
    return [[(float(x), float(y), float(depth[y, x])) for x, y in path] for path in traced(skeleton_graph(line)) if len(path) >= least]


def cubic_fit(points: np.ndarray) -> tuple[np.ndarray, float, int]:
    """Least-squares cubic Bezier through the ends at chord-length places; its largest miss and where."""
    gaps = np.hypot(*np.diff(points, axis=0).T)
    t = np.concatenate([[0.0], np.cumsum(gaps)]) / max(gaps.sum(), 1e-12)
    b = np.stack([(1 - t) ** 3, 3 * t * (1 - t) ** 2, 3 * t**2 * (1 - t), t**3], axis=1)
    inner, *_ = np.linalg.lstsq(b[:, 1:3], points - b[:, [0]] * points[0] - b[:, [3]] * points[-1], rcond=None)
    control = np.vstack([points[0], inner, points[-1]])
    miss = np.hypot(*(b @ control - points).T)
    return control, float(miss.max()), int(miss.argmax())


def fitted_curves(points: np.ndarray, error: float = 5.0) -> list[np.ndarray]:
    """Cubic curves that miss no point by more than the error; spans are cut where the miss is largest."""
    out, spans = [], [(0, len(points) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 1:
            continue
        control, miss, at = cubic_fit(points[a : b + 1])
        if miss <= error or b - a < 4:
            out.append(control)
        else:
            cut = min(max(a + at, a + 1), b - 1)
            spans += [(cut, b), (a, cut)]
    return out


def curve_points(control: np.ndarray, n: int) -> np.ndarray:
    t = np.linspace(0, 1, n)[:, None]
    return (1 - t) ** 3 * control[0] + 3 * t * (1 - t) ** 2 * control[1] + 3 * t**2 * (1 - t) * control[2] + t**3 * control[3]


def skeleton_strokes(mask: np.ndarray, error: float = 5.0, per_curve: int = 10) -> list[np.ndarray]:
    """A mask's skeleton as strokes smoothed by cubic curves."""
    return smoothed(traced(skeleton_graph(thinned(mask))), error, per_curve)


def smoothed(paths: Sequence[Sequence[tuple[int, int]]], error: float = 5.0, per_curve: int = 10) -> list[np.ndarray]:
    """Paths of more than one pixel as points of the cubic curves that fit them."""
    strokes = [np.array(p, float) for p in paths if len(p) > 1]
    return [np.vstack([curve_points(c, per_curve) for c in fitted_curves(s, error)]) for s in strokes]


def outline(mask: np.ndarray) -> np.ndarray:
    """Pixels (x, y) of the mask beside the background."""
    m = np.pad(mask, 1)
    inner = m[:-2, 1:-1] & m[2:, 1:-1] & m[1:-1, :-2] & m[1:-1, 2:]
    ys, xs = np.nonzero(mask & ~inner)
    return np.stack([xs, ys], axis=1)


def vertices(mask: np.ndarray) -> dict[int, tuple[float, float]]:
    """The outline pixel nearest to each of the nine anchors of the mask's box."""
    from .points import ANCHORS

    pixels = outline(mask)
    if not len(pixels):
        return {}
    low, high = pixels.min(axis=0), pixels.max(axis=0)
    return {r: tuple(pixels[((pixels - (low + (high - low) * np.array(a))) ** 2).sum(axis=1).argmin()].astype(float)) for r, a in ANCHORS.items()}


def morphed(template: Sequence[Sequence[int]], places: dict[int, tuple[float, float]], n: int = 50) -> list[np.ndarray]:
    """The strokes of a template of regions through a glyph's vertices, ``n`` points each, evenly spread over their lines."""
    out = []
    for regions in template:
        way = np.array([places[r] for r in regions if r in places], float)
        if len(way) < 2:
            continue
        marks = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(way, axis=0).T))])
        at = np.linspace(0, marks[-1], n)
        out.append(np.stack([np.interp(at, marks, way[:, i]) for i in (0, 1)], axis=1))
    return out


def minimal_strokes(mask: np.ndarray, variants: dict[str, Sequence[Sequence[int]]]) -> Iterator[tuple[str, str, float, list[np.ndarray]]]:
    """Phases (phase, variant, score, strokes) of finding a glyph's fewest strokes: each template variant, the skeleton, and the winner.

    The skeleton wins a tie. A score is the share of the mask near the strokes.
    """
    places, best = vertices(mask), ("none", -1.0, [])
    yield "render", "mask", float(mask.mean()), []
    judged = [(name, snapped_all(morphed(t, places), mask)) for name, t in variants.items()]
    judged.append(("skeleton", [np.array(p, float) for p in traced(skeleton_graph(thinned(mask))) if len(p) > 1]))
    for name, strokes in judged:
        score = near_share(mask, np.vstack(strokes)) if strokes else 0.0
        if score > best[1] or name == "skeleton" and score == best[1]:
            best = name, score, strokes
        yield "skeleton" if name == "skeleton" else "variant", name, score, strokes
    yield "complete", *best


def snapped_all(strokes: list[np.ndarray], mask: np.ndarray) -> list[np.ndarray]:
    return [snapped(s, mask) for s in strokes]


def png(image: np.ndarray) -> bytes:
    """PNG of an 8-bit grey (h, w) or colour (h, w, 3) image."""
    height, width = image.shape[:2]
    raw = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(image, np.uint8).reshape(height, -1))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def overlaps(size: int, n: int) -> np.ndarray:
    """Weights (size, n) by which ``n`` pixels in a row make up ``size`` ones of equal width."""
    edges = np.arange(size + 1) * (n / size)
    low, high = np.arange(n), np.arange(1, n + 1)
    shared = np.minimum(edges[1:, None], high) - np.maximum(edges[:-1, None], low)
    return np.maximum(shared, 0) * (size / n)


def cosines(count: int, n: int) -> np.ndarray:
    """The first ``count`` waves of the cosine transform of ``n`` values."""
    return np.cos(np.pi * np.arange(count)[:, None] * (2 * np.arange(n) + 1) / (2 * n))


def perceptual_bits(images: np.ndarray, side: int) -> np.ndarray:
    """Bits (n, side * side) of grey images (n, h, w): scaled by area, which of the lowest frequencies of the cosine transform are above their median."""
    scaled = overlaps(4 * side, images.shape[1]) @ images.astype(float) @ overlaps(4 * side, images.shape[2]).T
    waves = cosines(side, 4 * side)
    low = np.round(waves @ scaled @ waves.T, 4).reshape(len(images), -1)  # what is zero but for rounding is zero
    return low > np.median(low, axis=1, keepdims=True)


@F.pandas_udf(T.ArrayType(T.LongType()))
def perceptual_hash(image: pd.Series, width: pd.Series, side: pd.Series) -> pd.Series:
    """Perceptual hash of a grey image (bytes, row by row): side * side bits, 64 to a number, the highest first; null of no image.

    Images of one shape are transformed together. ``side`` is 8 or 16.
    """
    out: list = [None] * len(image)
    shapes: dict[tuple, list[int]] = {}
    for i, (data, w, k) in enumerate(zip(image, width, side, strict=True)):
        if data is not None and len(data) and w and len(data) % w == 0:
            shapes.setdefault((len(data), w, k), []).append(i)
    for (_, w, k), at in shapes.items():
        bits = perceptual_bits(np.stack([np.frombuffer(image[i], np.uint8).reshape(-1, w) for i in at]), k)
        for i, row in zip(at, np.packbits(bits, axis=1).view(">i8").astype(np.int64), strict=True):
            out[i] = row.tolist()
    return pd.Series(out, dtype=object)


def hash_text(numbers: Column) -> Column:
    """A hash as hex digits."""
    return F.lower(F.array_join(F.transform(numbers, lambda n: F.lpad(F.hex(n), 16, "0")), ""))


@F.pandas_udf(T.BinaryType())
def mask_png(mask: pd.Series, width: pd.Series) -> pd.Series:
    """Black on white."""
    return pd.Series([png(np.where(mask_of(m, w), 0, 255).astype(np.uint8)) if m else None for m, w in zip(mask, width, strict=True)])
