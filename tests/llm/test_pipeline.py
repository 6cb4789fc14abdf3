import random

import corpus_pipeline
from sieveline.llm import decontaminate, quality

from .helpers import prose, shingle_components


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    folder = str(tmp_path)
    item = prose(rng, 30)
    rows = []
    for i in range(300):
        text = prose(rng, 60)
        if i % 5 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif i % 7 == 0 and rows:
            text = rows[-1][1]
        elif i % 11 == 0:
            text += " " + item
        rows.append((i, text, "en", "s", len(text)))
    docs = spark.createDataFrame([*rows, (1000, None, None, None, None), (None, prose(rng, 30), None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out, left = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, folder)
        out.write.parquet(f"{folder}/{name}")
        out = spark.read.parquet(f"{folder}/{name}")
        if name != "encoding":
            assert out.columns == docs.columns
        left[name] = {r["doc_id"]: r["text"] if name != "encoding" else None for r in out.collect()}
    judged = {r["doc_id"]: r["predicted"] for r in quality.classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert set(left["quality"]) == {d for d, p in judged.items() if p}
    assert all(i % 5 for i in left["quality"] if i is not None and i < 1000)
    groups = shingle_components([(d, t) for d, t in left["quality"].items() if d is not None], 5, 8, 10)
    assert set(left["near_duplicates"]) - {None} == {c for _, c in groups.values()}
    held = {r["doc_id"] for r in decontaminate.find(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    assert set(left["decontamination"]) == set(left["near_duplicates"]) - held and held
    assert set(left["encoding"]) == set(left["decontamination"])
    ids = [r["doc_id"] for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and set(ids) == set(left["encoding"])


def odd_tables(spark, folder, rows):
    """Documents with nulls, repeats, columns of clashing names and a very long text, beside plain ones."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, print long, copies long, node long, kept_id long, score double, item_id long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] % 5 > 0), 0) for r in rows if r[0] is not None and r[0] < 300], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages_on_odd_rows(spark, tmp_path):
    rng, folder = random.Random(4), str(tmp_path)
    item = prose(rng, 30)
    extra = ("k", 1, 2, 3, 4, 0.5, 6)
    row = lambda i, text: (i, text, "en", "s", 1, *extra)
    rows = [row(i, " ".join(w.upper() + "!!" for w in prose(rng, 40).split()) if i % 5 == 0 else prose(rng, 40)) for i in range(200)]
    long = prose(rng, 190_000)
    same = prose(rng, 50)
    rows += [row(1000, long)] + [row(1001, same)] * 3 + [row(1002, same), row(None, same), row(1003, None), row(1004, ""), row(1005, " \n "), (None,) * 12, row(1006, long + " " + item)]
    docs = odd_tables(spark, folder, rows)
    spark.createDataFrame([(1, item), (2, None), (None, "one two")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert len(long) > 1_000_000
    left = {}
    out = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, out, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        out = spark.read.parquet(f"{folder}/{name}")
        left[name] = out.collect()
    good = [r for r in left["quality"] if r["doc_id"] is not None and r["doc_id"] < 300]
    assert {r["doc_id"] for r in good} <= {i for i in range(200) if i % 5} and len(good) > 120
    if any(r["text"] == same for r in left["quality"]):
        assert [r["doc_id"] for r in left["near_duplicates"] if r["text"] == same] == [1001]
    assert not any(item in (r["text"] or "") for r in left["decontamination"])
    assert all(tuple(r)[5:] == extra for r in left["decontamination"] if r["doc_id"] is not None)
    encoded = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r["doc_id"] for r in encoded), key=str) == sorted((r["doc_id"] for r in left["decontamination"]), key=str)


def test_an_empty_corpus(spark, tmp_path):
    folder = str(tmp_path)
    odd_tables(spark, folder, [])
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_ids_of_other_types(spark):
    rng = random.Random(6)
    item = prose(rng, 30)
    docs = spark.createDataFrame([("a", f"{prose(rng, 9)} {item}"), (None, item), ("c", prose(rng, 40))], "doc_id string, text string")
    found = decontaminate.find(docs, spark.createDataFrame([("x", item)], "item_id string, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {("a", "x"), (None, "x")}
