"""The search as a stream gives the frames of one that is never interrupted, also after a stop."""

import zlib

import numpy as np

from sieveline.streaming import search as Q

from test_waypoints import drawn


def test_search_goes_on_after_a_stop(spark, tmp_path):
    masks = {7: drawn([((8, 10), (40, 34))], 48, 1), 8: drawn([((20, 6), (22, 42))], 48, 2), 9: np.zeros((6, 6), bool)}
    schema = "glyph long, tick long, mask binary, width int"
    row = lambda g, t: (g, t, bytearray(masks[g].astype(np.uint8).tobytes()), masks[g].shape[1])

    def put(ticks):
        for t in ticks:
            spark.createDataFrame([row(g, t) for g in masks], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ticks")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/ticks")
        Q.run_search(stream, f"{tmp_path}/frames", f"{tmp_path}/checkpoint")

    put(range(3))
    run()  # and stops
    put(range(3, 9))
    run()
    got = {(r["glyph"], r["tick"]): tuple(r)[2:] for r in spark.read.parquet(f"{tmp_path}/frames").collect()}
    want = {}
    for g, mask in masks.items():
        s = Q.Search()
        for t in range(9):
            s.advance(mask, 10, 8, seed=zlib.crc32(str(g).encode()))
            want[g, t] = s.frame(t)[1:]
    assert got == want
    for g in (7, 8):
        best = [want[g, t][3] for t in range(9)]
        assert best == sorted(best) and best[-1] > 0.9 and want[g, 0][0] == "initial"
        assert [want[g, t][0] for t in range(9)] == sorted((want[g, t][0] for t in range(9)), key=Q.PHASES.index)


def test_a_search_ends():
    mask = drawn([((8, 10), (40, 34))], 48, 1)
    s = Q.Search()
    for t in range(60):
        s.advance(mask, 10)
    assert s.done and s.frame(60)[-1]
    before = s.state()
    s.advance(mask, 10)
    assert s.state() == before and 1 - s.cost > 0.9


def test_many_searches_move_on_as_each_alone():
    rng = np.random.default_rng(1)
    masks = [np.kron(rng.normal(size=(8, 8)) > 0, np.ones((4, 4), bool)) for _ in range(12)] + [rng.random((11, 70)) < 0.1, rng.random((40, 9)) < 0.5]
    masks += [np.zeros((6, 6), bool), np.zeros((0, 5), bool), np.ones((1, 1), bool)]
    for mask in masks:
        (alone, low, high), lines = Q.line_cost(mask), rng.uniform(-5, 45, (20, 4))
        lines[:5] = np.rint(lines[:5])
        together = Q.LineCosts(mask[None])
        assert np.array_equal(together.low[0], low) and np.array_equal(together.high[0], high)
        assert together(np.zeros(20, int), lines).tolist() == [alone(v) for v in lines]
    own, s = [Q.Search() for _ in masks], np.zeros(len(masks), Q.RECORD)
    for tick in range(9):
        for i, mask in enumerate(masks):
            own[i].advance(mask, 10, seed=i)
        Q.advance_all(s, masks, 10, seeds=list(range(len(masks))))
        got = Q.frames_all(s)
        for i, search in enumerate(own):
            phase, rounds, now, best, stroke, done = search.frame(tick)[1:]
            assert (got["phase"][i], got["rounds"][i], got["score"][i], got["best"][i], got["stroke"][i].tolist(), got["done"][i]) == (phase, rounds, now, best, stroke, done)
    assert any(search.done for search in own)


def test_glyphs_of_a_stream_are_searched_in_parts(spark, tmp_path):
    mask, schema = drawn([((8, 10), (40, 34))], 48, 1), "glyph long, tick long, mask binary, width int"
    rows = [(g, t, bytearray(mask.astype(np.uint8).tobytes()), 48) for g in [*range(40), None] for t in (1, 0, 2)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/ticks")
    Q.run_search(spark.readStream.schema(schema).parquet(f"{tmp_path}/ticks"), f"{tmp_path}/frames", f"{tmp_path}/checkpoint", parts=3)
    got = spark.read.parquet(f"{tmp_path}/frames").collect()
    states = spark.read.format("statestore").load(f"{tmp_path}/checkpoint").count()
    assert len(got) == len(rows) and states <= 4  # a state for each glyph before
    for g in (0, 39, None):
        s = Q.Search()
        for t in range(3):
            s.advance(mask, 10, 8, seed=zlib.crc32(str(g).encode()))
            assert [tuple(r)[2:] for r in got if (r["glyph"], r["tick"]) == (g, t)] == [s.frame(t)[1:]]
