import math
import random

import pytest
from pyspark.sql import functions as F

from sieveline.operators import aggregates as A
from sieveline.operators import changes as D
from sieveline.operators import ranking as R
from sieveline.operators import relational as J
from sieveline.operators import similarity as S
from sieveline.operators import spatial as G


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def frames(spark):
    items = spark.createDataFrame([(1, "Alpha"), (2, "beta"), (3, "9nine"), (4, "Ärger")], "id long, name string")
    checks = spark.createDataFrame([(1, True, 0.9), (2, None, 0.2)], "id long, dup boolean, score double")
    removals = spark.createDataFrame([(1, 8), (1, 2), (None, 8)], "asset_id long, reason_id long")
    return items, checks, removals


def test_needs_check_keeps_matched_rows_with_null(frames):
    items, checks, _ = frames
    assert rows(J.needing(items, checks, "id", "dup"), "id") == [(2,), (3,), (4,)]


def test_not_in_is_null_aware_and_anti_join_is_not(spark, frames):
    items, _, removals = frames
    assert rows(J.not_in(items, removals, "id", "asset_id"), "id") == []
    assert rows(J.not_in(items, removals.where("asset_id is not null"), "id", "asset_id"), "id") == [(2,), (3,), (4,)]
    assert rows(J.not_in(items, removals.limit(0), "id", "asset_id"), "id") == [(1,), (2,), (3,), (4,)]
    assert rows(J.without(items, removals, "id", "asset_id"), "id") == [(2,), (3,), (4,)]


def test_rejected_fans_out_unless_distinct(frames):
    items, _, removals = frames
    assert len(rows(J.rejected(items, removals, "id", "asset_id"))) == 2
    assert rows(J.rejected(items, removals, "id", "asset_id", distinct=True), "id") == [(1,)]


def test_eligible_passes_unknown(frames):
    items, checks, removals = frames
    assert rows(J.eligible(items, checks, removals.select(F.col("asset_id").alias("id")), "id", F.col("score") > 0.5), "id") == [(3,), (4,)]


def test_letters(frames):
    assert rows(A.letter_counts(frames[0], "name")) == [("#", 2), ("A", 1), ("B", 1)]


def test_staging_keeps_repeats_within_the_batch(spark):
    new = spark.createDataFrame([("x",), ("x",), ("y",)], "name string")
    assert rows(J.staged_anti(new, [spark.createDataFrame([("y",)], "name string")], "name")) == [("x",), ("x",)]


def test_containing_counts_letters(spark):
    words = spark.createDataFrame([("abba",), ("cab",)], "word string")
    fonts = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b", "c"])], "font long, glyphs array<string>")
    assert rows(J.containing(words, "word", fonts, "glyphs")) == [("abba", 1), ("abba", 2), ("cab", 2)]


def test_limits():
    assert [J.clamp_limit(v) for v in ("5", None, "x", 0, 101, 100)] == [5, 10, 10, 10, 10, 100]


def test_first_best_takes_the_first_of_equals(spark):
    runs = spark.createDataFrame([(1, 1, None), (1, 2, 0.5), (1, 3, 0.5), (1, 4, 0.4)], "k long, at long, v double")
    assert rows(R.first_best(runs, "k", "v", "at"), "at", "v") == [(2, 0.5)]
    assert rows(runs.where("v is not null").select("at", R.improves("v", "k", "at").alias("i"))) == [(2, True), (3, False), (4, False)]


def test_regressions(spark):
    old = spark.createDataFrame([("A", "ok", 0.9, 0.01), ("B", "ok", 0.5, 0.1), ("C", "ok", 0.5, 0.1)], "char string, status string, score double, overshoot double")
    new = spark.createDataFrame([("A", "ok", 0.8, 0.2, 1.0), ("B", "error", 0.0, 0.0, 1.0), ("C", "ok", 0.49, 0.1, 0.0)], "char string, status string, score double, overshoot double, topology double")
    got = rows(R.regressions(old, new, "char", ["score", "overshoot", "topology"]), "char", "metric", "change")
    assert got == [("A", "overshoot_regression", 0.19), ("A", "score_regression", 0.1), ("B", "status_change", None)]


def test_compare_runs_orders_unknown_as_zero(spark):
    a, b = (spark.createDataFrame(r, "k string, v double") for r in ([("a", 1.0), ("b", 1.0)], [("b", 0.5), ("c", 2.0)]))
    assert [(r["k"], r["delta"]) for r in R.by_delta(R.compare_runs(a, b, "k", "v"), "k").collect()] == [("b", -0.5), ("a", None), ("c", None)]


def test_every_kth_equals_global_rank(spark):
    df = spark.range(0, 1000, 3).select((F.col("id") * 7 % 1001).alias("x"))
    want = sorted(r[0] for r in df.collect())[9::10]
    assert sorted(r[0] for r in R.every_kth(df, "x", 10).collect()) == want


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_nearest_available_is_the_serial_rule(spark, seed):
    rng = random.Random(seed)
    wishes = [(i, rng.randint(0, 60)) for i in range(60)] + [(100 + i, 30) for i in range(6)] + [(200, 900)]
    items = [(i, rng.randint(0, 60)) for i in range(50)] + [(60 + i, 30) for i in range(3)]
    left, want = list(items), []
    for k, v in wishes:
        near = [x for x in left if abs(x[1] - v) <= 5]
        if near:
            hit = min(near, key=lambda x: (abs(x[1] - v), x[1], x[0]))
            left.remove(hit)
            want.append((k, hit[0], abs(hit[1] - v)))
    got = R.nearest_available(spark.createDataFrame(wishes, "k int, v int"), spark.createDataFrame(items, "i int, v int"), "k", "v", "i", 5)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert R.nearest_available(spark.createDataFrame([], "k int, v int"), spark.createDataFrame(items, "i int, v int"), "k", "v", "i").count() == 0


def test_radius_clusters_against_plain_search(spark):
    rng = random.Random(5)
    points = [(g, i, float(rng.randint(0, 40)), float(rng.randint(0, 40))) for g in range(4) for i in range(40)]
    want = {}
    for g in range(4):
        own = [p for p in points if p[0] == g]
        left = {p[1] for p in own}
        at = {p[1]: p[2:] for p in own}
        for first in sorted(left):
            if first not in left:
                continue
            todo = [first]
            left.discard(first)
            while todo:
                a = todo.pop()
                want[g, a] = first
                near = [b for b in left if (at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2 <= 25]
                left -= set(near)
                todo += near
    got = G.radius_clusters(spark.createDataFrame(points, "glyph int, id int, x double, y double"), 5.0)
    assert {(r["glyph"], r["id"]): r["cluster"] for r in got.collect()} == want


def test_together_is_all_or_nothing(spark, tmp_path):
    folder = str(tmp_path)
    assert D.versions(spark, folder) == {}
    with D.together(spark, folder) as new:
        new["a"], new["b"] = spark.range(3), spark.range(5)
    with pytest.raises(RuntimeError), D.together(spark, folder) as new:
        new["a"] = spark.range(1)
        raise RuntimeError
    with D.together(spark, folder) as new:
        new["b"] = spark.read.parquet(D.versions(spark, folder)["b"]).where("id < 2")
    assert {n: spark.read.parquet(p).count() for n, p in D.versions(spark, folder).items()} == {"a": 3, "b": 2}


def test_inverted_index_has_bounded_lists(spark):
    got = G.inverted_index(spark.range(2500).withColumn("k", F.lit("one")), "k", "id").orderBy("block").collect()
    assert [r["items"] for r in got] == [list(range(1000)), list(range(1000, 2000)), list(range(2000, 2500))]


def test_smoothing_keeps_constants(spark):
    df = spark.range(20).select(F.lit(1).alias("g"), "id", F.lit(3.0).alias("v"))
    assert all(abs(r[0] - 3) < 1e-9 for r in df.select(R.smoothed("v", "g", "id", 1.5)).collect())


def test_mutations(spark):
    table = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id long, name string, path string")
    new = spark.createDataFrame([("b",), ("c",), ("c",)], "name string")
    assert rows(D.insert_or_ignore(table, new, ["name"]), "id", "name") == [(1, "a"), (2, "b"), (3, "c")]
    up = spark.createDataFrame([(1, None, "z"), (9, "n", None)], "id long, name string, path string")
    assert rows(D.partial_upsert(table, up, ["id"])) == [(1, "a", "z"), (2, "b", None), (9, "n", None)]
    assert rows(D.insert_or_replace(table, up.select("id", "path"), ["id"])) == [(1, None, "z"), (2, "b", None), (9, None, None)]
    batch, after = D.claim(spark.createDataFrame([(1, "done"), (2, "pending"), (3, "pending")], "id long, status string"), 1)
    assert rows(batch, "id") == [(2,)] and rows(after, "id", "status") == [(1, "done"), (2, "downloading"), (3, "pending")]
    assert rows(D.reset_stuck(after), "status") == [("done",), ("pending",), ("pending",)]


def test_reject_and_unreject(spark, frames):
    reasons = spark.createDataFrame([(2, "duplicate"), (8, "manual")], "id long, code string")
    old = spark.createDataFrame([(1, 5, 8)], "id long, asset_id long, reason_id long")
    new = spark.createDataFrame([(5,), (6,)], "asset_id long")
    assert rows(D.reject(old, new, reasons, "manual"), "id", "asset_id") == [(1, 5), (2, 6)]
    with pytest.raises(ValueError):
        D.reject(old, new, reasons, "nothing")
    kept, gone = D.unreject(old, 8)
    assert kept.isEmpty() and gone.count() == 1


def test_replace_table(spark, tmp_path):
    folder = str(tmp_path / "t")
    D.replace_table(spark, spark.range(3), folder)
    D.replace_table(spark, spark.range(5), folder)
    assert D.current_table(spark, folder).count() == 5


def test_greedy_leader_is_not_transitive(spark):
    df = spark.createDataFrame([(1, 0b0), (2, 0b11), (3, 0b1111), (4, 0b0), (5, 7 << 40)], "id long, h long")
    groups = S.greedy_groups(df, "id", "h", 2, "id")
    assert rows(groups, "leader", "member") == [(1, 1), (1, 2), (1, 4), (3, 3), (5, 5)]
    best = S.keep_best(groups, spark.createDataFrame([(1, 0.1), (2, 0.9), (4, 0.9)], "id long, s double"), "id", "s", "id")
    assert rows(best.where("keep"), "leader", "member") == [(1, 2), (3, 3), (5, 5)]


def test_hamming_pairs_against_all_pairs(spark):
    import random

    random.seed(1)
    base = [random.getrandbits(62) for _ in range(20)]
    data = [(i, b ^ sum(1 << random.randrange(62) for _ in range(random.randrange(5)))) for i, b in enumerate(base * 4)]
    frame = spark.createDataFrame(data, "id long, h long")
    first = {h: min(i for i, x in data if x == h) for _, h in data}
    for threshold in (0, 2, 3, 8, 14):
        want = {(a, b): bin(x ^ y).count("1") for x, a in first.items() for y, b in first.items() if a < b and bin(x ^ y).count("1") <= threshold}
        got = {(r["a"], r["b"]): r["distance"] for r in S.hamming_pairs(frame, "id", "h", threshold).collect()}
        assert got == want and (want or not threshold)
    assert {(r["member"], r["first"]) for r in S.class_members(frame, "id", "h").collect()} == {(i, first[h]) for i, h in data}


def test_hamming_candidates_stay_below_all_pairs(spark):
    """At threshold 14 of 64 bits, random hashes meet in few of all pairs, copies in none."""
    import random

    random.seed(3)
    n = 600
    hashes = [random.getrandbits(63) for _ in range(n)]
    frame = spark.createDataFrame([(i, hashes[i % n]) for i in range(3 * n)], "id long, h long")
    spans, radius = S.bands(14)
    met = set()
    for low, high in spans:
        bits = [h >> low & (1 << high - low) - 1 for h in hashes]
        met |= {(i, j) for i in range(n) for j in range(i) if bin(bits[i] ^ bits[j]).count("1") <= radius}
    assert len(met) < 0.05 * n * (n - 1) / 2
    want = {(i, j) for i in range(n) for j in range(i) if bin(hashes[i] ^ hashes[j]).count("1") <= 14}
    assert {(r["b"], r["a"]) for r in S.hamming_pairs(frame, "id", "h", 14).collect()} == want


def test_nearest_of_all_points(spark):
    import random

    random.seed(5)
    pts = [(i, random.random() * (1 if i % 3 else 1000), random.random()) for i in range(60)] + [(100 + i, 5.0, 5.0) for i in range(4)]
    frame = spark.createDataFrame(pts, "id long, x double, y double")
    for k in (1, 3, 70):
        want = {(i, o, r + 1) for i, x, y in pts for r, (_, o) in enumerate(sorted(((x - u) * (x - u) + (y - v) * (y - v), o) for o, u, v in pts if o != i)[:k])}
        got = {(r["id"], r["other"], r["rank"]) for r in G.nearest_all(frame, frame.withColumnRenamed("id", "other"), 0.05, k).collect()}
        assert got == want


def test_errors_are_reported_by_row(spark):
    got = rows(S.parallel_map(spark.createDataFrame([(1, "4"), (2, "x")], "id long, v string"), "id", lambda v: int(v) + 1, ["v"]), "key", "success", "value")
    assert got == [(1, True, "5"), (2, False, None)]


def test_graph(spark):
    line = spark.createDataFrame([("g", x, 0) for x in range(5)] + [("g", 2, 1)], "glyph string, x int, y int")
    kinds = {(r["x"], r["y"]): r["kind"] for r in G.pixel_kinds(line, G.adjacency(line)).collect()}
    assert kinds[0, 0] == "end" and kinds[2, 1] == "junction"
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long")
    assert rows(G.connected(spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 8, 9)], "node long"), edges)) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 9)]


def test_rays_and_ends(spark):
    rays = spark.createDataFrame([("g", 1, 0, 0.0, 0.0, 1.0, 0.0)], "glyph string, id int, stroke int, x double, y double, dx double, dy double")
    segs = spark.createDataFrame([("g", 1, 5.0, -1.0, 5.0, 1.0), ("g", 2, 3.0, -1.0, 3.0, 1.0), ("g", 0, 1.0, -1.0, 1.0, 1.0)], "glyph string, stroke int, x1 double, y1 double, x2 double, y2 double")
    assert rows(G.ray_hits(rays, segs), "t", "of") == [(3.0, 2)]
    ends = spark.createDataFrame([("g", 0, 0, 0.0, 0.0), ("g", 1, 1, 0.0, 3.0), ("g", 2, 0, 9.0, 9.0)], "glyph string, stroke int, side int, x double, y double")
    assert rows(G.closest_ends(ends), "d", "stroke1", "stroke2") == [(3.0, 0, 1)]


def test_no_reason_and_no_anchor_is_cut(spark):
    from sieveline.operators import changes, spatial

    reasons = spark.range(10_050).selectExpr("id", "concat('c', id) code")
    rules = spark.range(10_050).selectExpr("id asset", "concat('c', id) reason")
    assert changes.removals_of_rules(rules, reasons, "asset").where("asset = reason_id").count() == 10_050
    pixels = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 5.0, 5.0, 0.0)], "glyph int, x double, y double, depth double")
    anchors = spark.createDataFrame([(i, float(i), float(i)) for i in range(12)], "region int, ax double, ay double")
    got = {r["region"]: r["x"] for r in spatial.anchor_pixels(pixels, anchors, 10.0).collect()}
    assert got == {i: 0.0 if i <= 2 else 5.0 for i in range(12)}


def test_nearest_value_takes_the_smallest_key_of_equal_and_missing_values(spark):
    rnd = random.Random(5)
    data = [(k, rnd.choice([None, *range(0, 24, 2)])) for k in rnd.sample(range(500), 120)]
    for some in (data, data[:1], [(1, None), (2, None), (3, 4)], [(k, 7) for k in range(9)]):
        frame = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in some], "k long, v double")
        far = lambda a, b: abs(a - b) if a is not None and b is not None else math.inf
        want = sorted((k, min((far(v, x), j) for j, x in some if j != k)[1]) for k, v in some if len(some) > 1)
        assert sorted((r["k"], r["nearest"]) for r in G.nearest_value(frame, "k", "v").collect()) == want


def test_wishes_and_items_of_one_value_are_settled_in_a_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(R, "settled", lambda df, label, real=R.settled: (rounds.append(label), real(df, label))[1])
    rnd = random.Random(3)
    wishes = [(k, 50 if k < 60 else rnd.randrange(100)) for k in range(120)]
    items = [(k, 50 if k < 40 else rnd.randrange(100)) for k in rnd.sample(range(300), 150)]
    free, want = dict(items), []
    for k, v in wishes:
        near = [(abs(x - v), x, i) for i, x in free.items() if abs(x - v) <= 5]
        if near:
            gap, _, i = min(near)
            want.append((k, i, gap))
            del free[i]
    got = R.nearest_available(spark.createDataFrame(wishes, "k long, v int"), spark.createDataFrame(items, "i long, v int"), "k", "v", "i")
    assert sorted((r["k"], r["i"], r["gap"]) for r in got.collect()) == want
    assert len(rounds) < 40  # a round for each copy before


def test_far_thresholds_are_compared_in_blocks(spark):
    rnd = random.Random(8)
    hashes = [rnd.getrandbits(64) - 2**63 for _ in range(60)]
    hashes += [h ^ (1 << rnd.randrange(63)) ^ (1 << rnd.randrange(63)) for h in hashes[:30]]
    frame = spark.createDataFrame([(h,) for h in set(hashes)], "h long")
    apart = lambda a, b: ((a ^ b) & 2**64 - 1).bit_count()
    want = {(a, b): apart(a, b) for a in set(hashes) for b in set(hashes) if a < b and apart(a, b) <= 26}
    got = S.block_pairs(frame, 26, block=16).collect()
    assert len(got) == len(want) > 30 and {(r["ha"], r["hb"]): r["distance"] for r in got} == want
    plan = lambda threshold: S.hamming_pairs(frame.select("h", F.col("h").alias("k")), "k", "h", threshold)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan(14) and "FlatMapGroupsInArrow" not in plan(3)
