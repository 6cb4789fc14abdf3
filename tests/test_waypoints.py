"""Waypoints against plain loops on drawn letters, and traces on shapes whose strokes are known."""

import math
import random

import numpy as np
import pytest

from sieveline.functions import glyphs as Y
from sieveline.functions.templates import NUMPAD, Templates
from sieveline.operators import waypoints as W


def drawn(lines, size=48, thick=2):
    mask = np.zeros((size, size), bool)
    for (x0, y0), (x1, y1) in lines:
        for x, y in Y.line_pixels(x0, y0, x1, y1):
            mask[max(0, y - thick) : y + thick + 1, max(0, x - thick) : x + thick + 1] = True
    return mask


def glyph_rows(spark, masks):
    return spark.createDataFrame([(i, c, bytearray(m.astype(np.uint8).tobytes()), m.shape[1]) for i, (c, m) in enumerate(masks)], "glyph long, char string, mask binary, width int")


def plain_waypoint(bones, edge, region, kind, direction):
    """The pixel of one waypoint, found by loops in the order of the definition."""
    (x0, y0, x1, y1), pixels = bones.box, bones.graph
    tx, ty = x0 + (region - 1) % 3 / 2 * (x1 - x0), y0 + (2 - (region - 1) // 3) / 2 * (y1 - y0)
    h, mx, my = y1 - y0, (x0 + x1) / 2, (y0 + y1) / 2
    upper, lower = y0 + h / 3, y0 + 2 * (h / 3)
    far = lambda p: (p[0] - tx) ** 2 + (p[1] - ty) ** 2
    pick = lambda ps, key: min(ps, key=lambda p: (key(p), far(p), p[1], p[0]))
    joints = [p for p in pixels if len(pixels[p]) > 2]
    along = {"down": lambda p: p[1], "up": lambda p: -p[1], "left": lambda p: -p[0], "right": lambda p: p[0]}.get(direction, far)
    here = [p for p in pixels if bones.inside(p, region)]
    if kind == "crossing":
        return pick([p for p in joints if p in here] or pixels, far), None
    if kind == "curve":
        side = [p for p in pixels if (p[1] < my - 0.05 * h if ty < my else p[1] > my + 0.05 * h)]
        return (pick(side, lambda p: p[0] if tx < mx else -p[0]) if side and tx != mx else pick(pixels, far)), None
    if kind == "vertex":
        if upper <= ty <= lower:
            waist = [p for p in pixels if abs(p[1] - my) < 0.15 * h]
            return (pick(waist, lambda p: p[0] if tx < mx else -p[0]) if waist else pick(pixels, far)), None
        top = ty < upper
        p = pick(pixels, lambda p: p[1] if top else -p[1])
        tips = [(e["top"] if top else -e["bottom"], e["x"]) for e in edge if abs(e["x"] - p[0]) <= 5]
        y, x = min(tips)
        return p, (x, abs(y), "top" if top else "bottom") if (abs(y) < p[1] if top else abs(y) > p[1]) else None
    pool = here or [p for p in pixels if (p[1] < upper if ty < upper else p[1] > lower if ty > lower else upper <= p[1] <= lower)]
    if not pool:
        return pick(pixels, far), None
    if region in (1, 3, 7, 9):
        ends = [p for p in here if len(pixels[p]) == 1]
        return pick(ends or pool, along), None
    turn = {"down": (45, 135), "up": (-135, -45), "right": (-45, 45)}
    good = [(s["sx"], s["sy"]) for s in bones.paths if direction and s["size"] > 10 and (abs(s["angle"]) > 135 if direction == "left" else turn[direction][0] <= s["angle"] <= turn[direction][1])]
    near = lambda p, r: any(abs(p[0] - a) <= r and abs(p[1] - b) <= r for a, b in good)
    one = [p for p in good if bones.inside(p, region)] + [p for p in joints if p in pool and near(p, 3)]
    two = [p for p in joints if p in pool and near(p, 5)]
    return (pick(one, far) if one else pick(two, far) if two else pick(pool, along)), None


def plain_direction(a, b):
    up, right = (b - 1) // 3 - (a - 1) // 3, (b - 1) % 3 - (a - 1) % 3
    if abs(up) == abs(right):
        return None
    return ("up" if up > 0 else "down") if abs(up) > abs(right) else ("right" if right > 0 else "left")


def test_waypoints_against_plain_loops(spark):
    rng = random.Random(2)
    at = lambda r: (6 + (r - 1) % 3 * 17 + rng.randint(-2, 2), 6 + (2 - (r - 1) // 3) * 17 + rng.randint(-2, 2))
    masks = []
    for char, variants in sorted(NUMPAD.items()):
        lines = []
        for stroke in next(iter(variants.values())):
            places = [at(int(str(i).strip("vci()"))) for i in stroke if i != "straight"]
            lines += zip(places, places[1:])
        masks += [(char, drawn(lines)), (char, drawn([(at(rng.randint(1, 9)), at(rng.randint(1, 9))) for _ in range(3)]))]
    masks += [("A", np.zeros((9, 9), bool)), ("A", np.ones((3, 1), bool)), (None, drawn([((5, 5), (20, 20))])), ("?", drawn([((5, 5), (20, 20))]))]
    glyphs = W.skeletons(glyph_rows(spark, masks))
    got = {(r["glyph"], r["variant"], r["stroke"], r["seq"]): ((r["x"], r["y"]), (r["ax"], r["ay"], r["tip"]) if r["tip"] else None) for r in W.resolved(glyphs, Templates(numpad=True).frame(spark)).collect()}
    want = {}
    for r in glyphs.collect():
        s = r["skeleton"]
        bones = W.Skeleton(s["pixels"], s["paths"], (s["x0"], s["y0"], s["x1"], s["y1"]))
        for variant, strokes in NUMPAD.get(r["char"], {}).items():
            for k, items in enumerate(strokes):
                ways = [(int(str(i).strip("vci()")), {"v": "vertex", "c": "curve", "i": "crossing"}.get(str(i)[0], "point")) for i in items if i != "straight"]
                for q, (region, kind) in enumerate(ways):
                    direction = plain_direction(region, ways[q + 1][0]) if q + 1 < len(ways) else None
                    want[r["glyph"], variant, k, q] = plain_waypoint(bones, s["edge"], region, kind, direction)
    assert {k: v for k, v in got.items() if v != want.get(k)} == {} and got.keys() == want.keys()
    assert len({k[0] for k in got}) > 120 and sum(v[1] is not None for v in got.values()) > 10


def chebyshev(points):
    return sum(max(abs(a["x"] - b["x"]), abs(a["y"] - b["y"])) for a, b in zip(points, points[1:]))


def test_traces_of_known_shapes(spark):
    shapes = {
        "L": [((6, 6), (6, 40)), ((6, 40), (40, 40))],
        "T": [((6, 6), (40, 6)), ((23, 6), (23, 40))],
        "H": [((6, 6), (6, 40)), ((40, 6), (40, 40)), ((6, 23), (40, 23))],
        "V": [((6, 6), (23, 40)), ((23, 40), (40, 6))],
        "O": [((6, 6), (40, 6)), ((40, 6), (40, 40)), ((40, 40), (6, 40)), ((6, 40), (6, 6))],
    }
    masks = [(c, drawn(lines)) for c, lines in shapes.items()]
    judged = W.minimal_strokes(glyph_rows(spark, masks), Templates(numpad=True).frame(spark)).collect()
    best = {r["char"]: r for r in judged if r["won"]}
    assert set(best) == set(shapes) and all(r["score"] > 0.8 for r in best.values())
    by = {(r["char"], r["variant"]): r["strokes"] for r in judged}
    assert len(by["L", "default"]) == 1 and chebyshev(by["L", "default"][0]) > 60
    assert len(by["T", "default"]) == 2 and [len(s) for s in by["T", "default"]] == [30, 30]
    h = by["H", "default"]
    assert len(h) == 3 and abs(h[0][0]["x"] - 6) <= 3 and abs(h[1][0]["x"] - 40) <= 3 and h[0][0]["y"] < h[0][-1]["y"]
    assert h[2][0]["x"] < h[2][-1]["x"] and abs(h[2][15]["y"] - 23) <= 2
    v = by["V", "default"][0]
    assert max(p["y"] for p in v) >= 38 and v[0]["x"] < 15 and v[-1]["x"] > 30
    o = by["O", "closed"][0]
    assert chebyshev(o) > 90  # all around
    for r in judged:  # strokes keep to the mask
        m = dict(masks)[r["char"]]
        assert all(m[round(p["y"]), round(p["x"])] for s in r["strokes"] for p in s)


def test_straight_hints_and_vertical_chains(spark):
    glyphs = W.skeletons(glyph_rows(spark, [("z", drawn([((6, 6), (40, 40)), ((40, 6), (6, 40))])), ("w", drawn([((8, 6), (8, 20)), ((8, 20), (9, 40)), ((9, 20), (40, 20))]))]))
    templates = Templates().add("z", "hinted", [["7", "straight", "i(5)", "down", "3"]]).add("w", "stem", [["7", "1"]]).frame(spark)
    ways = {(r["char"], r["seq"]): r for r in W.waypoints(templates).collect() if r["char"] in "zw"}
    assert ways["z", 0]["straight"] and not ways["z", 1]["straight"] and ways["z", 1]["direction"] == "down" and ways["w", 0]["vertical"]
    found = W.resolved(glyphs, templates)
    strokes = {r["glyph"]: r["strokes"] for r in W.traced_strokes(glyphs, found).collect()}
    cross = strokes[0][0]
    assert math.dist((cross[0]["x"], cross[0]["y"]), (6, 6)) < 6 and math.dist((cross[-1]["x"], cross[-1]["y"]), (40, 40)) < 6
    stem = strokes[1][0]
    assert stem[0]["y"] < 12 and stem[-1]["y"] > 34 and all(p["x"] < 14 for p in stem)


@pytest.mark.parametrize("rows", [[], [("A", np.zeros((4, 4), bool))]])
def test_nothing_to_find(spark, rows):
    assert W.minimal_strokes(glyph_rows(spark, rows), Templates(numpad=True).frame(spark)).count() == 0


def test_frames_come_in_order(spark):
    glyphs = glyph_rows(spark, [("L", drawn([((6, 6), (6, 40)), ((6, 40), (40, 40))]))])
    frames = [r for f in W.phases(W.minimal_strokes(glyphs, Templates(numpad=True).frame(spark)), glyphs) for r in f.collect()]
    assert [r["phase"] for r in frames] == ["render", "variant", "skeleton", "complete"]
    assert frames[-1]["score"] == max(r["score"] for r in frames[1:-1])
