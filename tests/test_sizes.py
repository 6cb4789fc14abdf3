"""That the work and the memory of a query grow no faster than its rows."""

import math
import os

import numpy as np
from pyspark.sql import functions as F

from sieveline.functions import glyphs as Y
from sieveline.functions import text as X
from sieveline.operators import waypoints as W
from sieveline.plans.catalog import Tables

FOLDER = os.environ.get("SIEVELINE_TEST_TABLES", "/root/testdata/sf0.001")


def test_python_gets_small_batches_whatever_the_table(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        Tables(spark, FOLDER)
        assert int(spark.conf.get(name)) <= 1000
    finally:
        spark.conf.set(name, before)


def test_softmax_has_each_power_once(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0],), ([],), (None,)], "v array<double>").select(X.softmax(F.col("v")).alias("p"))
    assert df._jdf.queryExecution().analyzed().toString().lower().count("exp(") == 1
    got = [r["p"] for r in df.collect()]
    e = [math.exp(v - 4) for v in (1.0, 2.0, 4.0)]
    assert got[0] == [v / sum(e) for v in e] and got[1:] == [[], None]


def test_a_mask_is_thinned_once_for_its_skeleton(spark):
    mask = np.ones((6, 6), np.uint8)
    glyphs = spark.createDataFrame([(1, bytearray(mask.tobytes()), 6)], "glyph long, mask binary, width int")
    df = W.skeletons(glyphs)
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {(p["x"], p["y"]) for p in df.first()["skeleton"]["pixels"]} == {(int(x), int(y)) for y, x in np.argwhere(Y.thinned(mask > 0))}


def test_masks_of_many_shapes_are_thinned_together():
    rng = np.random.default_rng(3)
    masks = [rng.random((h, w)) < 0.7 for h, w in ((5, 9), (8, 8), (5, 9), (1, 4), (8, 8))]
    assert all(np.array_equal(a, Y.thinned(m)) for a, m in zip(Y.thinned_masks(masks), masks, strict=True))


def test_points_at_masks_are_moved_without_objects(spark):
    mask = np.zeros((4, 4), np.uint8)
    mask[1, 1:3] = 1
    rows = [(1, bytearray(mask.tobytes()), [(0.0, 0.0), (3.5, 3.0), (1.25, 1.0)]), (2, bytearray(16), [(5.0, 5.0)]), (3, bytearray(mask.tobytes()), []), (4, bytearray(mask.tobytes()), None)]
    df = spark.createDataFrame(rows, "id long, mask binary, p array<struct<x:double,y:double>>")
    plan = df.select("id", Y.snap("mask", F.lit(4), "p").alias("s"), Y.snap_near("mask", F.lit(4), "p", F.lit(1.5)).alias("n"), Y.centre_by_rays("mask", F.lit(4), "p").alias("c"))
    got = {r["id"]: tuple(None if v is None else [tuple(q) for q in v] for v in r[1:]) for r in plan.collect()}
    assert got[1] == ([(1.0, 1.0), (2.0, 1.0), (1.25, 1.0)], [(1.0, 1.0), (3.5, 3.0), (1.0, 1.0)], [(0.0, 0.0), (3.5, 3.0), (1.25, 1.0)])
    assert got[2] == ([(5.0, 5.0)],) * 3 and got[3] == ([],) * 3 and got[4] == (None,) * 3


def test_pixels_are_not_shuffled_to_find_waypoints(spark):
    from sieveline.functions.templates import Templates

    mask = np.ones((12, 12), np.uint8)
    glyphs = W.skeletons(spark.createDataFrame([(1, "A", bytearray(mask.tobytes()), 12)], "glyph long, char string, mask binary, width int"))
    plan = W.resolved(glyphs, Templates().frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortAggregate" not in plan


def test_distances_within_reach_do_not_depend_on_the_reach():
    rng = np.random.default_rng(5)
    for mask in (rng.random((14, 17)) < 0.03 for _ in range(20)):
        far, near = Y.distance_squared(mask)[0], Y.distance_squared(mask, 3.5)[0]
        assert np.array_equal(far <= 3.5**2, near <= 3.5**2) and np.array_equal(far[far <= 3.5**2], near[far <= 3.5**2])


def test_what_is_left_of_a_paged_job_is_read_by_one_query(spark, tmp_path, monkeypatch):
    from sieveline.streaming.jobs import PagedJob

    for category, n in (("a", 4), ("b", 3)):
        for page in range(1, n + 1):
            folder = tmp_path / "listing" / f"category={category}" / f"page={page}"
            folder.mkdir(parents=True)
            (folder / "part-0.txt").write_text(f"{category}{page}x\n{category}{page}y\n")
    started, plain = [], PagedJob._query
    monkeypatch.setattr(PagedJob, "_query", lambda self, **how: started.append(how) or plain(self, **how))
    job = PagedJob(spark, str(tmp_path / "found"), str(tmp_path / "checkpoint"), {"categories": "a,b", "fetcher": "sieveline.sources.pages.listed_page", "base": str(tmp_path / "listing"), "pages": "1", "max_pages": "100"})
    assert job.run(2) == 2 and job.found().count() == 4
    assert job.run() >= 5 and len(started) == 3
    assert sorted(r["url"] for r in job.found().collect()) == sorted(f"{c}{p}{x}" for c, n in (("a", 4), ("b", 3)) for p in range(1, n + 1) for x in "xy")


def test_copies_at_one_place_do_not_meet_each_other(spark, monkeypatch):
    from sieveline.operators import spatial as G

    rng = np.random.default_rng(7)
    places = [(1, 1)] * 300 + [(2, 1)] * 100 + [(50, 60)] + [(float(x), float(y)) for x, y in rng.integers(0, 9, (60, 2))]
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(places)], "id long, x double, y double")
    met, plain = [], G.radius_join
    monkeypatch.setattr(G, "radius_join", lambda *a: (df := plain(*a), met.append(df.count()))[0])
    got = sorted((r["id"], r["rank"], r["other"]) for r in G.nearest_all(points, points.withColumnRenamed("id", "other"), 0.5, 2).collect())
    want = []
    for i, (x, y) in enumerate(places):
        near = sorted(((x - a) ** 2 + (y - b) ** 2, j) for j, (a, b) in enumerate(places) if j != i)[:2]
        want += [(i, n + 1, j) for n, (_, j) in enumerate(near)]
    assert got == sorted(want) and max(met) < 20 * len(places)


def test_counters_of_a_stream_need_no_python(spark, tmp_path):
    from sieveline.streaming import progress

    src, out, schema = str(tmp_path / "in"), {}, "job long, bad boolean"

    def run(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        counts = progress.running_counts(spark.readStream.schema(schema).parquet(src), "job", "bad")
        assert "Python" not in counts._jdf.queryExecution().analyzed().toString() and "Pandas" not in counts._jdf.queryExecution().analyzed().toString()
        counts.writeStream.outputMode("update").foreachBatch(lambda df, n: out.update({r["job"]: (r["checked"], r["failed"]) for r in df.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    run([(1, True), (1, None), (2, False)])
    assert out == {1: (2, 1), 2: (1, 0)}
    run([(1, True), (3, True), (None, False)])
    assert out == {1: (3, 2), 2: (1, 0), 3: (1, 1), None: (1, 0)}


def test_entries_of_an_archive_leave_in_batches():
    import io
    import zipfile

    from sieveline.sources import files

    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        for i in range(2500):
            z.writestr(f"fonts/{i:04d}.ttf", b"x" * (i % 50))
    got = list(files.entries_of([("a", archive.getvalue())] * 2, (".ttf",), "fonts/"))
    assert len(got) == 5
    one = [("a", f"fonts/{i:04d}.ttf", f"{i:04d}.ttf", b"x" * (i % 50)) for i in range(2500)]
    assert [r for f in got for r in f.itertuples(index=False, name=None)] == one * 2


def test_strokes_of_many_glyphs_are_merged_in_one_batch(spark):
    from sieveline.functions import strokes as K

    rng = np.random.default_rng(11)
    lines, joints, want = [], [], {}
    for glyph in range(40):
        x, y, own = int(rng.integers(0, 9)), int(rng.integers(0, 9)), []
        for stroke, (dx, dy) in enumerate(((1, 0), (-1, 0), (0, 1), (1, 1))[: 1 + glyph % 4]):
            n = int(rng.integers(2, 30))
            own.append([(float(x + dx * i), float(y + dy * i)) for i in range(n)])
            lines.append((glyph, stroke, own[-1]))
        dots = [(0, x, y), (0, x + 1, y), (2, x - 30, y)] if glyph % 5 else []
        joints += [(glyph, *d) for d in dots]
        want[glyph] = K.merge_pipeline(own, [{(x, y), (x + 1, y)}, {(x - 30, y)}] if dots else [])
    lines.append((None, 0, [(0.0, 0.0), (9.0, 9.0)]))
    joints.append((99, 0, 1, 1))
    strokes = spark.createDataFrame(lines, "glyph long, stroke int, points array<struct<x:double,y:double>>")
    df = K.merge_strokes(strokes, spark.createDataFrame(joints, "glyph long, junction int, x int, y int"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMap" not in plan and "Join" not in plan
    got = {}
    for r in df.orderBy("glyph", "stroke").collect():
        got.setdefault(r["glyph"], []).append([tuple(p) for p in r["points"]])
    assert got.pop(None) == K.merge_pipeline([[(0.0, 0.0), (9.0, 9.0)]])
    assert got == {g: s for g, s in want.items() if s}


def test_fonts_of_equal_characters_meet_words_once(spark):
    from sieveline.operators import relational as J

    fonts = spark.createDataFrame([(i, list("abc" if i % 2 else "cbaa")) for i in range(200)] + [(900, list("ab")), (901, []), (902, None), (903, list("abc")), (903, list("abc"))], "id long, g array<string>")
    words = spark.createDataFrame([("cab",), ("bb",), ("ad",), (None,)], "word string")
    df = J.containing(words, "word", fonts, "g")
    got = sorted((r["word"], r["id"]) for r in df.collect())
    all_of = [*range(200), 903, 903]
    assert got == sorted([("cab", i) for i in all_of] + [("bb", i) for i in [*all_of, 900]])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    explode = plan.split("Generate explode(_set")[1]
    assert "Aggregate" in explode.split("Project")[0] + explode.split("Generate")[0]


def test_points_of_many_groups_are_clustered_as_rows(spark, monkeypatch):
    from sieveline.operators import spatial as G

    rng = np.random.default_rng(13)
    rows = [(g, i, int(x), int(y)) for g in range(25) for i, (x, y) in enumerate(rng.integers(0, 12, (g * 2 + 1, 2)))] + [(None, 1, 0, 0), (None, 2, 0, 1)]
    points = spark.createDataFrame(rows, "glyph long, id int, x int, y int")
    called, plain = [], G.connected
    monkeypatch.setattr(G, "connected", lambda *a: called.append(1) or plain(*a))
    results = []
    for most in (1000, 20):
        monkeypatch.setattr(G, "ALONE", most)
        results.append(sorted((r["glyph"] is None, r["glyph"] or 0, r["id"], r["x"], r["y"], r["cluster"]) for r in G.radius_clusters(points, 2.0).collect()))
    assert results[0] == results[1]
    known = points.where("glyph IS NOT NULL")
    monkeypatch.setattr(G, "ALONE", 1000)
    called.clear()
    assert G.radius_clusters(known, 2.0).count() == known.count() and not called
    of = {(n, g, i): c for n, g, i, _, _, c in results[0]}
    assert of[True, 0, 1] == 1 and of[True, 0, 2] == 2
    for g in range(25):
        own = {i: (x, y) for h, i, x, y in rows if h == g}
        root = {i: i for i in own}
        for _ in own:
            root = {i: min(root[j] for j in own if (own[i][0] - own[j][0]) ** 2 + (own[i][1] - own[j][1]) ** 2 <= 4) for i in own}
        assert all(of[False, g, i] == root[i] for i in own)


def test_each_pair_of_blocks_has_a_task_and_hashes_are_made_once(spark):
    from sieveline.operators import similarity as S

    rng = np.random.default_rng(13)
    hashes = np.unique(rng.integers(-(2**62), 2**62, 200))
    hashes = np.unique(np.concatenate([hashes, hashes[:60] ^ (1 << rng.integers(0, 60, 60)) ^ (1 << rng.integers(0, 60, 60))]))
    frame = spark.createDataFrame([(int(h),) for h in hashes], "h long")
    pairs = S.block_pairs(frame, 14, block=32)
    assert pairs.rdd.getNumPartitions() >= 28  # small blocks were joined into one task
    got = {(r["ha"], r["hb"]): r["distance"] for r in pairs.collect()}
    want = {(a, b): d for a in hashes.tolist() for b in hashes.tolist() if a < b and (d := ((a ^ b) & 2**64 - 1).bit_count()) <= 14}
    assert got == want and len(want) > 50

    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def hashed(h):
        made.add(1)
        return h

    rows = frame.select("h", F.monotonically_increasing_id().alias("id")).select("id", hashed("h").alias("h"))
    assert S.greedy_groups(rows, "id", "h", 14, "id").count() == len(hashes) == made.value


def test_near_pairs_are_found_over_the_edges_of_strips():
    from sieveline.operators import similarity as S

    rng = np.random.default_rng(17)
    a, b = rng.integers(0, 2**63, 37, dtype=np.uint64), rng.integers(0, 2**63, 23, dtype=np.uint64)
    apart = np.bitwise_count(a[:, None] ^ b[None, :])
    found = [np.stack(f, axis=1) for f in S.near_in_blocks(a, b, 30, 8, 5)]
    assert sorted(map(tuple, np.concatenate(found).tolist())) == [(int(i), int(j), int(apart[i, j])) for i, j in np.argwhere(apart <= 30)]
    assert not list(S.near_in_blocks(a, b, 0, 8, 5))


def test_masks_of_a_batch_are_thinned_and_measured_once(monkeypatch):
    import pandas as pd

    rng = np.random.default_rng(19)
    masks = [np.kron(rng.random((8, 8)) < 0.5, np.ones((4, 4), bool)) for _ in range(20)] + [np.zeros((4, 4), bool), np.ones((4, 4), bool)]
    data, width = pd.Series([m.astype(np.uint8).tobytes() for m in masks]), pd.Series([m.shape[1] for m in masks])
    want = [(int((b := Y.thinned(m)).sum()), int(Y.without_spurs(b, 2).sum()), len(Y.traced(Y.skeleton_graph(b))), len(Y.skeleton_strokes(m, 1.0)), len(Y.segments_of(b))) for m in masks]
    ridges = {k: Y.ridge_counts.func(data, width, pd.Series([k] * len(masks))) for k in Y.RIDGES}
    calls, thin, far = [], Y.thinned, Y.distance_squared
    monkeypatch.setattr(Y, "thinned", lambda m: calls.append("thinned") or thin(m))
    monkeypatch.setattr(Y, "distance_squared", lambda *a: calls.append("depth") or far(*a))
    assert list(Y.skeleton_summary.func(data, width).itertuples(index=False, name=None)) == want
    assert calls == ["thinned"] * 2  # by shapes; twice for each mask before
    got = Y.all_ridge_counts.func(data, width)
    assert calls.count("depth") == len(masks) - 1 and calls.count("thinned") == 2 + 2 * len(Y.RIDGES)
    for k in Y.RIDGES:
        assert [tuple(v.values()) for v in got[k]] == list(ridges[k].itertuples(index=False, name=None))
    assert Y.ink_share.func(data, width).tolist() == Y.mask_metrics.func(data, width)["ink"].tolist()


def test_a_listing_has_a_file_for_a_hundred_pages(spark, tmp_path):
    from sieveline.sources import pages as H

    base = f"{tmp_path}/listing"
    rows = spark.range(2500).selectExpr("concat('c', id % 2) category", "id", "CAST(1 + id div 20 AS int) page", "concat('u', id, IF(id = 8, ' a\\nb', '')) url").repartition(7)
    H.write_listing(rows, base, "id")
    assert sorted(p.parent.name for p in (tmp_path / "listing").rglob("part-*")) == ["block=0", "block=0", "block=1", "block=1"]
    got = [H.page_of_listing(base, f"c{k}", page) for page in range(1, 126) for k in (0, 1)]
    assert got == [[f"u{i}" + (" a\nb" if i == 8 else "") for i in range(20 * page - 20 + k, 20 * page, 2)] for page in range(1, 126) for k in (0, 1)]
    assert H.page_of_listing(base, "c0", 126) == H.page_of_listing(base, "c0", 900) == H.page_of_listing(base, "c9", 1) == []
