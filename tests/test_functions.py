import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sieveline.functions import glyphs as Y
from sieveline.functions import points as P
from sieveline.functions import text as X


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def pts(*xy):
    return F.array(*[P.point(x, y) for x, y in xy])


def test_text(spark):
    lit = F.lit
    assert one(spark, X.edit_confidence(lit("\n Ab "), lit("ab")), X.edit_confidence(lit("a"), lit("")), X.edit_confidence(lit("a"), lit("ERROR x"), errors=True)) == (1.0, 0.0, 0.0)
    assert one(spark, X.safe_file_name(lit("a/b:c. ")), X.safe_file_name(lit(" . "))) == ("a_b_c", "unnamed")
    assert one(spark, X.stem(lit("/x/a.b.ttf")), X.base_name(lit("/x/a.ttf")), X.quote(lit("a b~*/"))) == ("a.b", "a.ttf", "a%20b~%2A%2F")
    assert one(spark, X.unescape(lit("&amp;lt;")), X.percent(lit(0.123))) == ("&lt;", "12.3%")
    assert one(spark, X.accepted(lit("O"), lit("0"), lit(0.6)), X.accepted(lit("O"), lit("0"), lit(0.4)), X.accepted(lit("a"), lit("A"), lit(0.0)), X.accepted(lit("a"), lit("z"), lit(1.0))) == (True, False, True, False)
    a, b = (X.hash_halves(lit(h)) for h in ("ffffffff00000000", "fffffffe00000001"))
    assert one(spark, X.hamming(a, b)) == (2,)


def test_ratio(spark):
    assert spark.createDataFrame([("abcd", "bcde"), (None, "a")], "a string, b string").select(X.matching_ratio("a", "b").alias("r")).collect()[0]["r"] == 0.75


def test_points(spark):
    line = pts((0, 0), (3, 4), (3, 4), (3, 10))
    assert one(spark, P.path_length(line), F.size(P.without_repeats(line))) == (11.0, 3)
    assert one(spark, P.running(P.steps(line)) == F.transform(line, lambda p: P.subtract(p, P.point(0.0, 0.0)))) == (True,)
    got = one(spark, P.resampled(pts((0, 0), (10, 0)), 5))[0]
    assert [p["x"] for p in got] == [0, 2.5, 5, 7.5, 10]
    assert len(one(spark, P.resampled(pts((1, 1)), 5))[0]) == 1
    turned = one(spark, P.affine(pts((0, 0), (2, 0)), theta=math.pi / 2))[0]
    assert [round(p["y"], 6) for p in turned] == [-1, 1]
    assert one(spark, P.box(F.array().cast("array<struct<x:double,y:double>>"))["x_max"]) == (0.0,)
    assert one(spark, P.normalised(P.point(0.001, 0))["x"], P.heading(F.lit(0.0), F.lit(1.0))) == (0.0, 90.0)
    curve = one(spark, P.bezier([P.point(0, 0), P.point(1, 2), P.point(2, 0)], 2))[0]
    assert [tuple(p) for p in curve] == [(0, 0), (1, 1), (2, 0)]
    spline = one(spark, P.catmull_rom(pts((0, 0), (1, 1), (2, 0)), 4))[0]
    assert tuple(spline[4]) == (1, 1) and len(spline) == 9


def test_pen_and_padding(spark):
    rows = P.pen_rows(F.array(pts((0, 0), (1, 1)), pts((2, 2))))
    assert [r["pen"] for r in one(spark, rows)[0]] == [0, 1, 1]
    assert one(spark, P.five_state(rows))[0][-1] == [2.0, 2.0, 0.0, 0.0, 1.0]
    kept, mask = P.padded(F.array(F.lit(1), F.lit(2)), 4, F.lit(0))
    assert one(spark, kept, mask) == ([1, 2, 0, 0], [1, 1, 0, 0])


def test_templates(spark):
    ways, hints = P.template_segments(F.array(*[F.lit(s) for s in ("9", "down", "8", "straight", "left", "7", "v(4)", "??", "1")]))
    w, h = one(spark, ways, hints)
    assert [x["region"] for x in w] == [9, 8, 7, 4, 1] and w[3]["kind"] == "vertex"
    assert h == [["down"], ["straight", "left"], [], []]


def test_grid(spark):
    b = F.struct(F.lit(0.0).alias("x_min"), F.lit(0.0).alias("y_min"), F.lit(3.0).alias("x_max"), F.lit(3.0).alias("y_max"))
    assert one(spark, P.grid_cell(F.lit(0.0), F.lit(0.0), b), P.grid_cell(F.lit(2.9), F.lit(2.9), b), P.grid_cell(F.lit(3.0), F.lit(0.0), b)) == (7, 3, None)
    assert tuple(one(spark, P.cell_centre(F.lit(5), b))[0]) == (1.5, 1.5)
    assert tuple(one(spark, P.anchor_point(F.lit(7), b))[0]) == (0, 0)


def test_labelling_and_holes():
    ring = np.zeros((9, 9), bool)
    ring[2:7, 2:7] = True
    ring[4, 4] = False
    assert Y.has_hole(ring) and Y.labelled(ring)[1] == 1
    ring[0, 0] = True
    assert Y.shape_metrics(ring) == (2, 5 / 9)
    rng = np.random.default_rng(0)
    m = rng.random((30, 30)) < 0.4
    seen, n = np.zeros_like(m), 0
    for y, x in zip(*np.nonzero(m), strict=True):
        if not seen[y, x]:
            n, todo = n + 1, [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < 30 and 0 <= b < 30 and m[a, b] and not seen[a, b]:
                    seen[a, b] = True
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert Y.labelled(m)[1] == n


def test_distance_transform():
    rng = np.random.default_rng(1)
    m = rng.random((17, 23)) < 0.05
    m[3, 4] = True
    ys, xs = np.nonzero(m)
    want = ((np.arange(17)[:, None, None] - ys) ** 2 + (np.arange(23)[None, :, None] - xs) ** 2).min(axis=2)
    assert (Y.distance_squared(m)[0] == want).all()


def test_skeleton_and_tracing():
    m = np.zeros((20, 40), bool)
    m[8:12, 3:37] = True
    s = Y.thinned(m)
    assert 20 <= s.sum() <= 40
    assert max(len(p) for p in Y.traced(Y.skeleton_graph(s))) > 20


def test_strokes():
    assert len(Y.simplified(np.array([[0, 0], [1, 0.01], [2, 0], [2, 5.0]]), 0.1)) == 3
    assert Y.line_pixels(0, 0, 3, 1) == [(0, 0), (1, 0), (2, 1), (3, 1)]
    a, b = np.array([[x, 0] for x in range(30)]), np.array([[x, 0] for x in range(31, 60)])
    assert len(Y.merged([a, b])) == 1
    assert Y.smoothed_locked([[0, 0], [3, 9, 1], [6, 0], [9, 0]])[1] == [3, 9, 1]
    assert Y.svg_path("M0 0 L10 0 h5 v5 z") == [[(0.0, 0.0), (10.0, 0.0), (15.0, 0.0), (15.0, 5.0), (0.0, 0.0)]]
    assert Y.svg_path("m1 1 2 2")[0] == [(1.0, 1.0), (3.0, 3.0)]
    end = Y.svg_path("M0 0 A5 5 0 0 1 10 0")[0]
    assert abs(min(p[1] for p in end) + 5) < 0.3 and abs(end[-1][0] - 10) < 1e-6
    best, value = Y.minimised(lambda v: float(((v - [1, 2]) ** 2).sum()), np.zeros(2))
    assert value < 1e-3


def test_mask_udf(spark):
    m = np.zeros((4, 4), np.uint8)
    m[1:3, 1:3] = 255
    df = spark.createDataFrame(pd.DataFrame({"m": [m.tobytes()], "w": [4]}))
    assert df.select(Y.mask_metrics("m", "w").alias("r")).first()["r"]["shapes"] == 1


@pytest.mark.parametrize("value,want", [(0.0, 0.0), (0.05, 0.6875), (0.2, 0.8)])
def test_baseline(spark, value, want):
    from sieveline.operators.aggregates import baseline_score

    assert abs(one(spark, baseline_score(F.lit(value)))[0] - want) < 1e-9


def test_matching_ratio_compares_whole_turns(spark, tmp_path):
    from difflib import SequenceMatcher

    from sieveline.plans.catalog import QUERIES

    turns = [(1, 0, "u", "same start " * 8 + "one end"), (1, 1, "a", "same start " * 8 + "another"), (1, 2, "u", None), (1, 3, "a", ""), (1, 4, "u", ""), (2, 0, "u", "x" * 70 + "yz"), (2, 1, "a", "x" * 70 + "q"), (2, 3, "a", "alone")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["conv_id"], r["turn"]): r["ratio"] for r in QUERIES["matching_ratio"](spark, str(tmp_path)).collect()}
    text = {(c, t): x for c, t, _, x in turns}
    want = {(c, t): None if x is None or text[c, t + 1] is None else round(SequenceMatcher(None, x, text[c, t + 1]).ratio(), 6) for (c, t), x in text.items() if (c, t + 1) in text}
    assert got.keys() == want.keys() and all(got[k] == want[k] or abs(got[k] - want[k]) < 2e-6 for k in want)


def test_searches_of_many_rows_are_those_of_each_row_alone():
    rng = np.random.default_rng(4)
    a = rng.normal(0, 1, (7, 2))
    points, values = Y.chained_all(lambda p: ((p - a) ** 2).sum(axis=1) + np.cos(3 * p).sum(axis=1), [(-1.0, 1.0)] * 2, np.zeros((7, 2)))
    for c, point, value in zip(a, points, values, strict=True):
        p, v = Y.chained(lambda q, c=c: float(((q - c) ** 2).sum() + np.cos(3 * q).sum()), [(-1.0, 1.0)] * 2, np.zeros(2))
        assert np.allclose(p, point, atol=1e-9) and math.isclose(v, value, abs_tol=1e-12)
    assert [x.shape for x in Y.chained_all(lambda p: p.sum(axis=1), [(-1.0, 1.0)] * 2, np.zeros((0, 2)))] == [(0, 2), (0,)]
