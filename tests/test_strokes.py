import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.functions import glyphs as Y
from sieveline.functions import points as P
from sieveline.functions import strokes as K


def run(x0, y0, dx, dy, n):
    return [(float(x0 + i * dx), float(y0 + i * dy)) for i in range(n)]


def test_headings_run_along_each_stroke():
    g = K.Glyph([run(0, 0, 1, 0, 10), run(19, 0, -1, 0, 10), run(9, 0, 1, 0, 10)], [{(9, 0), (10, 0)}])
    assert g.heading(0, 1) == (1.0, 0.0) and g.heading(1, 1) == (-1.0, 0.0) and g.heading(2, 0) == (1.0, 0.0)
    assert g.bend((0, 1), (1, 1)) == 0 and g.bend((0, 1), (2, 0)) == math.pi
    assert [len(s) for s in g.by_direction().strokes] == [20, 10]


def test_ends_are_at_the_first_junction_beside_them():
    g = K.Glyph([[(3.4, 0.6), (9, 9)]], [{(5, 5)}, {(4, 2)}, {(3, 1)}])
    assert g.places() == [(1, -1)] and g.ends() == {1: [(0, 0)]}
    assert K.Glyph([[]]).places() == [(-1, -1)]


def test_bars_at_t_junctions():
    up, down, bar, other = run(10, 30, 0, -1, 31), run(10, -30, 0, 1, 31), run(10, 0, 1, 0, 6), run(15, 0, 0, 1, 30)
    joined = K.Glyph([up, down, bar, other], [{(10, 0)}, {(15, 0)}]).t_junctions().strokes
    assert sorted(len(s) for s in joined) == [30, 62]
    assert len(K.Glyph([up, down, run(10, 0, 1, 0, 20), other], [{(10, 0)}, {(29, 0)}]).t_junctions().strokes) == 4  # no short bar


def test_stubs_of_an_apex_extend_the_legs():
    left, right, tip = run(0, 30, 1, -1, 30), run(60, 30, -1, -1, 30), [(30.0, 0.0), (30.0, -3.0), (30.0, -6.0)]
    got = K.Glyph([left, right, tip], [{(30, 0), (29, 1), (30, 1), (31, 1)}]).converging_stubs().strokes
    assert len(got) == 2 and all(s[-1] == (30.0, -6.0) for s in got)
    assert len(K.Glyph([left, tip], [{(30, 0), (29, 1)}]).converging_stubs().strokes) == 2  # one leg alone


def test_presets_and_own_passes():
    assert K.PRESETS["aggressive"].bend > K.PRESETS["default"].bend > K.PRESETS["conservative"].bend
    K.PASSES["reverse"] = lambda g, p: g.strokes.reverse()
    try:
        assert K.merge_pipeline([[(0, 0)], [(1, 1)]], passes=["reverse"]) == [[(1, 1)], [(0, 0)]]
    finally:
        del K.PASSES["reverse"]


def test_merge_to_count():
    pieces = [run(0, 0, 1, 0, 5), run(9, 0, -1, 0, 5), run(100, 0, 1, 0, 5)]
    assert [len(s) for s in K.Glyph(pieces).to_count([2]).strokes] == [10, 5]
    assert len(K.Glyph(pieces).to_count([3, 1]).strokes) == 3 and len(K.Glyph(pieces).to_count([]).strokes) == 3
    assert [len(s) for s in K.Glyph(pieces).to_count([1]).strokes] == [15]


def test_junction_groups_by_distance():
    groups = K.cluster_junctions([(0, 0), (1, 1), (5, 0), (40, 0), (41, 0)], 12)
    assert sorted(map(len, groups)) == [2, 3]
    assert sorted(map(len, K.cluster_junctions([(0, 0), (1, 1), (5, 0)], 2))) == [1, 2] and K.cluster_junctions([]) == []


def test_shape_bounds():
    assert K.SHAPES["vline"].defaults == (0.5, 0.25, 0.75) and K.SHAPES["loop"].valid((0.5, 0.5, 0.3, 0.3))
    assert not K.SHAPES["loop"].valid((0.5, 0.5, 0.3)) and not K.SHAPES["loop"].valid((0.5, 0.5, 0.3, 0.9))
    bounds, spans = K.parameter_bounds([{"shape": "arc_left"}, {"shape": "hline", "bounds": [(0.4, 0.6)]}])
    assert spans == [(0, 6), (6, 9)] and bounds[6] == (0.4, 0.6) and bounds[7:] == [(0.0, 0.5), (0.5, 1.0)]
    assert K.sample_count(30, 40) == 60 and K.sample_count(300, 400) == 333


def test_scores_and_penalties():
    mask = np.zeros((40, 40), bool)
    mask[5:35, 15:25] = True
    canvas = K.Canvas(mask, 6.0)
    inside = np.array(run(20, 5, 0, 1, 30))
    scorer = K.Scorer()
    assert scorer([inside], canvas) == pytest.approx(-1 + 0.1 * K.at_edge(inside, canvas.snapped(inside), [], canvas))
    outside = inside + (15, 0)
    assert scorer([outside], canvas) > scorer([inside], canvas) and K.off_mask(outside, canvas.snapped(outside), [], canvas) == 1
    twice = scorer([inside, inside], canvas)
    assert scorer.remove("overlap") and not scorer.remove("overlap") and twice - scorer([inside, inside], canvas) == pytest.approx(0.5 * 0.75)
    assert scorer.add("one", 2.0, lambda *a: 1.0)([inside], canvas) == pytest.approx(scorer.__class__({"edge": scorer.penalties["edge"], "snap": scorer.penalties["snap"]})([inside], canvas) + 2)
    assert scorer([], canvas) == scorer([np.zeros((1, 2))], canvas) == 0.0


def test_hooks_report_errors(spark):
    Y.register_hook("half", lambda n: n / (n % 3), "double")
    got = {r["id"]: (r["value"], r["error"]) for r in Y.call_hook(spark.range(5), "half", ["id"]).collect()}
    assert got[4] == (4.0, None) and got[3][0] is None and got[3][1].startswith("ZeroDivisionError")
    with pytest.raises(ValueError):
        Y.call_hook(spark.range(1), "unknown", ["id"])


def test_search_meets_its_bounds():
    bowl = lambda p: float((p[0] - 0.3) ** 2 + (p[1] - 5) ** 2)
    point, value = Y.chained(bowl, [(-1, 1), (-1, 1)], np.zeros(2))
    assert np.allclose(point, (0.3, 1.0), atol=1e-3) and value == pytest.approx(16, abs=1e-2)
    assert np.allclose(Y.differential_evolution(bowl, [(-9, 9)] * 2)[0], (0.3, 5), atol=0.05)


def test_ridges_spurs_and_curves():
    mask = np.zeros((40, 60), bool)
    mask[15:24, 5:55] = True
    for kind in ("crest", "curve", "slope"):
        line, depth = Y.ridge(mask, kind)
        assert line.any() and (mask | ~line).all() and set(np.nonzero(line)[0].tolist()) <= set(range(15, 24))
    bones = np.zeros((20, 40), bool)
    bones[10, 2:38] = True
    bones[7:10, 20] = True
    assert Y.without_spurs(bones, 3).sum() < bones.sum() and not Y.without_spurs(bones, 3)[7:9].any()
    curve = np.array([(t, math.sin(t / 8) * 10) for t in range(60)], float)
    fitted = Y.fitted_curves(curve, 0.5)
    assert all(np.min(np.hypot(*(np.vstack([Y.curve_points(c, 200) for c in fitted]) - p).T)) < 0.7 for p in curve)
    assert len(Y.fitted_curves(curve, 50)) == 1


def test_minimal_strokes_prefers_the_better():
    mask = np.zeros((60, 60), bool)
    mask[5:55, 27:33] = True
    phases = list(Y.minimal_strokes(mask, {"bar": [[8, 5, 2]], "corner": [[7, 9]]}))
    assert [p[0] for p in phases] == ["render", "variant", "variant", "skeleton", "complete"]
    assert phases[-1][2] == max(p[2] for p in phases[1:4]) and phases[-1][1] in ("bar", "skeleton")


def test_png_is_read_by_its_own_rules():
    import struct
    import zlib

    data = Y.png(np.arange(12, dtype=np.uint8).reshape(3, 4))
    at, parts = 8, {}
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        parts[kind], at = body, at + 12 + n
    assert zlib.decompress(parts[b"IDAT"]) == b"".join(b"\0" + bytes(range(4 * i, 4 * i + 4)) for i in range(3))


def test_noise_is_normal_and_repeats(spark):
    rows = spark.range(4000).select(K.noise(F.col("id"), F.lit(3), 2.0).alias("n"), K.noise(F.col("id"), F.lit(3), 2.0).alias("again"))
    r = rows.agg(F.avg("n").alias("m"), F.stddev("n").alias("s"), F.max(F.abs(F.col("n") - F.col("again"))).alias("d")).first()
    assert abs(r["m"]) < 0.12 and abs(r["s"] - 2) < 0.12 and r["d"] == 0


def test_styles_with_noise_stay_near(spark):
    line = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: P.point(i, 0.0))
    style = K.Style(rotation=2.0, shift=0.1, wander=0.05, noise=0.02)
    got = spark.range(3).select(style.apply(line, F.col("id"), F.col("id")).alias("q")).collect()
    assert all(len(r["q"]) == 10 and all(abs(p["x"] - i) < 2 and abs(p["y"]) < 2 for i, p in enumerate(r["q"])) for r in got)
    assert len({r["q"][0]["x"] for r in got}) == 3


@pytest.mark.parametrize("end,most,n", [((100, 50), math.pi / 4, 1), ((50, 100), math.pi / 4, 2), ((100, 100), math.pi / 2, 1), ((100, 100), math.pi / 8, 2)])
def test_joins_by_the_bend_at_a_junction(end, most, n):
    to_junction = lambda x, y: [(x + (50 - x) * i / 14, y + (50 - y) * i / 14) for i in range(15)]
    near = {(50 + dx, 50 + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)}
    got = K.Glyph([to_junction(0, 50), to_junction(*end)], [near]).by_direction(most).strokes
    assert len(got) == n and sum(map(len, got)) == 30


def test_arms_at_a_t_and_a_lone_spur():
    line = lambda a, b, n: [(a[0] + (b[0] - a[0]) * i / (n - 1), a[1] + (b[1] - a[1]) * i / (n - 1)) for i in range(n)]
    arms = [line((0, 50), (50, 50), 30), line((100, 50), (50, 50), 30)]
    g = K.Glyph([*arms, line((50, 50), (50, 55), 5)], [{(50, 50)}, {(50, 55)}]).t_junctions()
    assert [len(s) for s in g.strokes] == [60]
    assert len(K.Glyph([*arms, line((50, 50), (50, 55), 5)], [{(50, 50)}]).t_junctions().strokes) == 3  # the bar ends nowhere
    assert K.merge_pipeline([]) == [] and len(K.merge_pipeline([line((0, 0), (100, 100), 25)])) == 1


def test_pixel_contours_close_by_the_gap_of_their_ends_or_always(spark):
    rows = spark.createDataFrame([([[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 0.4)]],)], "c array<array<struct<x:double,y:double>>>")
    size = lambda **how: rows.select(F.size(F.get(K.pixel_contours(F.col("c"), F.lit(10.0), F.lit(0.0), 10.0, F.lit(0.0), F.lit(0.0), **how), F.lit(0)))).first()[0]
    assert (size(), size(apart=0.3), size(apart=None)) == (4, 5, 5)
