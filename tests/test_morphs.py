import numpy as np
from pyspark.sql import functions as F

from sieveline.operators import morphs as M

from test_waypoints import drawn, glyph_rows


def test_corners_of_drawn_letters(spark):
    letters = {
        "A": [((24, 6), (6, 42)), ((24, 6), (42, 42)), ((14, 28), (34, 28))],
        "B": [((6, 6), (6, 42)), ((6, 6), (32, 6)), ((32, 6), (32, 20)), ((32, 20), (6, 24)), ((22, 24), (40, 28)), ((40, 28), (40, 42)), ((40, 42), (6, 42))],
        "P": [((6, 6), (6, 42)), ((6, 6), (34, 6)), ((34, 6), (34, 22)), ((34, 22), (6, 22))],
        "L": [((6, 6), (6, 42)), ((6, 42), (40, 42))],
    }
    glyphs = glyph_rows(spark, [(c, drawn(lines)) for c, lines in letters.items()])
    strokes = M.morphed(glyphs).collect()
    by = {(list(letters)[r["glyph"]], r["stroke"]): [(p["x"], p["y"]) for p in r["points"]] for r in strokes}
    assert set(by) == {("A", 0), ("A", 1), ("A", 2), ("B", 0), ("B", 1), ("B", 2), ("P", 0), ("P", 1), ("L", 0), ("L", 1)}
    assert by["A", 0][0] == by["A", 1][0] and by["A", 0][0][1] == 4.0  # both legs begin at the top
    assert by["A", 0][-1][0] < 12 < 36 < by["A", 1][-1][0]
    bar = by["A", 2]
    assert bar[0][0] < 20 and bar[-1][0] > 28
    assert max(x for x, _ in by["B", 1]) >= 32 and max(x for x, _ in by["B", 2]) >= 40  # the bumps
    assert abs(by["B", 1][-1][1] - by["B", 2][0][1]) < 1  # they meet at the waist
    for (char, k), points in by.items():
        if k not in M.AS_DRAWN.get(char, []):
            mask = drawn(letters[char])
            assert all(mask[round(y), round(x)] for x, y in points), (char, k)
    assert M.morphed(glyph_rows(spark, [("A", np.zeros((5, 5), bool)), ("?", drawn(letters["L"]))])).count() == 0


def test_refined_against_plain_rounds():
    rng = np.random.default_rng(0)
    mask = drawn([((6, 6), (40, 40)), ((40, 6), (6, 40))])
    ys, xs = np.nonzero(mask)
    points = np.cumsum(rng.normal(0, 3, (30, 2)), axis=0) + 24
    p = [list(q) for q in points]
    on = lambda q: 0 <= round(q[0]) < 48 and 0 <= round(q[1]) < 48 and mask[round(q[1]), round(q[0])]
    near = lambda q: min(zip(ys, xs), key=lambda a: ((a[1] - q[0]) ** 2 + (a[0] - q[1]) ** 2, a[0], a[1]))[::-1]
    for _ in range(100):
        out = [i for i, q in enumerate(p) if not on(q)]
        if not out:
            break
        for i in out:
            p[i] = list(map(float, near(p[i])))
        p = [p[0]] + [[0.2 * p[i - 1][k] + 0.6 * p[i][k] + 0.2 * p[i + 1][k] for k in (0, 1)] for i in range(1, len(p) - 1)] + [p[-1]]
    p = [q if on(q) else list(map(float, near(q))) for q in p]
    assert np.allclose(M.refined(points, mask), p)
    assert M.refined(points, np.zeros((3, 3), bool)) is points


def test_lines_get_their_share(spark):
    places = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(0.0).alias("y")) for x in (0, 10, 11, 41)])
    got = spark.range(1).select(M.drawn(places, 60).alias("p")).first()["p"]
    assert len(got) == 14 + 2 + 43 + 1 and got[0]["x"] == 0 and got[-1]["x"] == 41 and got[14]["x"] == 10


def test_pixels_are_never_broadcast(spark):
    from sieveline.plans.registry import QUERIES

    plans = [QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString() for name in ("letter_corners", "morphed_strokes")]
    assert [p.count("BroadcastHashJoin") for p in plans] == [0, 1]  # the templates


def test_strokes_are_refined_together_as_by_whole_searches():
    rng = np.random.default_rng(3)
    masks = [rng.random((20 + k % 3, 23)) < 0.2 + 0.02 * k for k in range(30)] + [np.zeros((4, 4), bool)]
    points = [rng.integers(-6, 50, (25, 2)) / 2 for _ in masks]  # halves: several pixels are nearest
    for points_, mask, got in zip(points, masks, M.refined_together(points, masks, 7), strict=True):
        ys, xs = np.nonzero(mask)
        off = lambda q: not (0 <= (x := round(q[0])) < mask.shape[1] and 0 <= (y := round(q[1])) < mask.shape[0] and mask[y, x])
        p = points_
        for n in range(8 if len(xs) else 0):
            out = [i for i, q in enumerate(p) if off(q)]
            if not out:
                break
            p = p.copy()
            for i in out:
                k = ((xs - p[i, 0]) ** 2 + (ys - p[i, 1]) ** 2).argmin()
                p[i] = xs[k], ys[k]
            if n < 7:
                p = np.concatenate([p[:1], 0.2 * p[:-2] + 0.6 * p[1:-1] + 0.2 * p[2:], p[-1:]])
        assert np.array_equal(got, p)


def test_rows_and_outline_of_a_mask():
    mask = np.array([[0, 0, 0, 0, 0, 0], [1, 0, 0, 0, 1, 0], [0, 1, 0, 0, 1, 1], [0, 1, 1, 1, 1, 0], [0, 1, 1, 1, 0, 0]], bool)
    y, left, right, gap, rim = M.look(mask)
    assert [list(v) for v in (y, left, right, gap)] == [[1, 2, 3, 4], [0, 1, 1, 1], [4, 5, 4, 3], [True, False, False, False]]
    assert set(np.flatnonzero(mask)) - set(rim) == set()
    assert list(M.look(np.ones((3, 3), bool))[4]) == [0, 1, 2, 3, 5, 6, 7, 8] and not len(M.look(np.zeros((2, 3), bool))[4])


def test_a_glyph_leaves_as_one_row_and_not_as_pixels(spark):
    plan = M.morphed(glyph_rows(spark, [("L", drawn([((6, 6), (6, 42))]))]))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "array<struct<x:int" not in plan and plan.count("SortMergeJoin") == 1
