import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sieveline import schemas
from sieveline.sources import files, pages
from sieveline.streaming import progress


def fetch_two(category, page):
    return {1: [f"{category}/a", f"{category}/b"], 2: [f"{category}/b", f"{category}/c"], 3: [f"{category}/c"]}.get(page, [])


def test_list_page(spark):
    html = '<a href="/dancing-pen.font"> Dancing <b>Pen</b></a><span>10,500 downloads</span><a href="/x.font">Download</a><a href="/plain.font">Plain</a>'
    got = pages.list_page(spark.createDataFrame([(1, html), (2, "")], "id long, html string"), "id", "html", "https://site.example", "https://dl.example/?f=").orderBy("pos").collect()
    assert [(r["name"], r["url"], r["download_url"], r["downloads"]) for r in got] == [("Dancing Pen", "https://site.example/dancing-pen.font", "https://dl.example/?f=dancing_pen", 10500), ("Plain", "https://site.example/plain.font", "https://dl.example/?f=plain", 0)]


def test_search_page_keeps_first(spark):
    html = '<a href="/font/a">One</a><a href="/font/a">Two</a><a href="/font/b">x</a><a href="/font/c">Share</a>'
    got = pages.search_page(spark.createDataFrame([(1, html)], "id long, html string"), "id", "html", "https://s.example").collect()
    assert [(r["name"], r["url"]) for r in got] == [("One", "https://s.example/font/a")]


def test_json_and_css(spark):
    r = spark.range(1).select(pages.guarded_json(F.lit(")]}'\n{\"a\": 3}"), "a int")["a"], pages.first_css_url(F.lit("src: url(https://cdn.example/x.ttf) url(https://cdn.example/y.ttf)"), "cdn.example")).first()
    assert tuple(r) == (3, "https://cdn.example/x.ttf")


def test_fetch_retries():
    answers, waits = iter([(429, {"Retry-After": "7"}, b""), (503, {}, b""), (200, {}, b"ok")]), []
    assert pages.fetch(lambda u: next(answers), "u", sleep=waits.append) == (200, b"ok") and waits == [7.0, 2.0]
    assert pages.fetch(lambda u: (404, {}, b""), "u", sleep=waits.append) == (404, b"")


def test_paged_source(spark):
    spark.dataSource.register(pages.PageSource)
    assert list(pages.paginate(lambda p: fetch_two("k", p), 9)) == [(1, "k/a"), (1, "k/b"), (2, "k/c")]


def test_svg_font(spark, tmp_path):
    (tmp_path / "f.svg").write_text('<font id="F1" horiz-adv-x="9"><glyph unicode="a" horiz-adv-x="5" d="M0 0L1 1"/><glyph d="M2 2" unicode="b"/><glyph unicode="c" d=""/></font>')
    got = pages.svg_glyphs(spark, str(tmp_path / "f.svg")).orderBy("unicode").collect()
    assert [(r["font"], r["unicode"], r["advance"]) for r in got] == [("F1", "a", 5.0), ("F1", "b", None)]


def test_archives(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("fonts/s1/a.ttf", b"A")
        z.writestr("fonts/s2/b.otf", b"B")
        z.writestr("readme.txt", b"")
        z.writestr("manifest.json", json.dumps({"fonts": [{"path": "fonts/s1/a.ttf", "name": "Alpha", "source": "site"}]}))
    (tmp_path / "x.zip").write_bytes(data.getvalue())
    glob = str(tmp_path / "*.zip")
    got = files.import_archives(files.zip_entries(spark, glob, folder="fonts/"), files.zip_manifest(spark, glob, "path: STRING, name: STRING, source: STRING")).orderBy("entry").collect()
    assert [(r["name"], r["source"]) for r in got] == [("Alpha", "site"), ("b", "s2")]
    made = files.write_archive(spark.createDataFrame([("s", "n", "n.ttf", b"1"), ("s", "m", "m.ttf", None)], "source string, name string, file_name string, content binary"), f"{tmp_path}/out/made.zip").first()
    assert made["n_files"] == 1 and json.loads(zipfile.ZipFile(made["path"]).read("manifest.json"))["font_count"] == 1


def test_scan_register_and_append(spark, tmp_path):
    for n in ("b.ttf", "a.otf", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    found = files.scan(spark, str(tmp_path))
    assert [r["path"].rsplit("/", 1)[1] for r in found.collect()] == ["a.otf", "b.ttf"]
    new, counts = files.register_files(found, found.limit(1).select(F.col("path").alias("file_path")))
    assert new.count() == 1 and {r["status"]: r["n"] for r in counts.collect()} == {"registered": 1, "already_registered": 1}
    target = str(tmp_path / "out")
    assert files.append_missing(spark.range(3), "id", target) == 3 and files.append_missing(spark.range(5), "id", target) == 2


def test_schema_bootstrap(spark):
    schemas.bootstrap(spark)
    schemas.bootstrap(spark)
    assert spark.table("assets").count() == 0
    assert schemas.migrate(schemas.empty(spark, "jobs").drop("current_page"), {"current_page": "int"}).columns[-1] == "current_page"


def test_stream_counters_match_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), []
    spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 3, True)], "job long, at long, bad boolean").write.parquet(src)
    stream = spark.readStream.schema("job long, at long, bad boolean").parquet(src)
    q = progress.running_counts(stream, "job", "bad").writeStream.outputMode("update").foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["job"], r["checked"], r["failed"]) for r in out) == [(1, 2, 1), (2, 1, 1)]


def test_drain_resumes(spark, tmp_path):
    src, seen = str(tmp_path / "in"), []
    run = lambda: progress.drain(progress.unique_stream(spark.readStream.schema("url string").parquet(src), "url"), lambda df, n: seen.extend(r["url"] for r in df.collect()), str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([("a",), ("b",), ("a",)], "url string").write.parquet(src)
    run()
    spark.createDataFrame([("b",), ("c",)], "url string").write.mode("append").parquet(src)
    run()
    assert sorted(seen) == ["a", "b", "c"]


def test_progress_frames(spark):
    df = spark.range(1, 6).select(F.lit(1).alias("job"), "id", (F.col("id") == 3).alias("bad"))
    got = progress.progress_frames(progress.progress(df, "job", "id", "bad"), "job", "id", 2).orderBy("checked").collect()
    assert [r["type"] for r in got] == ["start", "progress", "progress", "done"] and got[-1]["failed"] == 1


def test_sqlite_evaluates_filters(spark, tmp_path):
    rows = [(i, f"n{i % 7}" if i % 5 else None, i / 3, bytearray([i % 256])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, name string, x double, raw binary").repartition(3)
    path = f"file://{tmp_path}/some/t.db"
    assert files.write_sqlite(df, path, "t").first()["n_rows"] == 500
    back = files.read_sqlite(spark, path, "t", "id long, name string, x double, raw binary", 3)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    read = lambda *where: sorted(r["id"] for r in files.read_sqlite(spark, path, "t", "id long", 3, where).collect())
    assert read(("id", ">", 30), ("id", "<=", 400), ("name", "in", ["n1", "n2"]), ("x", "<", 100.5), ("raw", "is not null", None)) == [i for i, n, x, _ in rows if 30 < i <= 400 and n in ("n1", "n2") and x < 100.5]
    assert read(("name", "is null", None)) == list(range(0, 500, 5)) and read(("name", "=", "n1'; --")) == [] and read(("id", "=", 7)) == [7]
    assert back.where("name >= 'n3' OR id = 1").count() == sum(n is not None and n >= "n3" or i == 1 for i, n, *_ in rows)
    with pytest.raises(ValueError):
        files.SqliteReader({"path": path, "table": "t", "schema_ddl": "id long", "where": '[["id", "like", "x"]]'})
    files.write_sqlite(df.limit(0), f"{tmp_path}/none.db", "t")
    assert files.read_sqlite(spark, f"{tmp_path}/none.db", "t", "id long").count() == 0


def test_pages_are_read_once_across_stops():
    asked = []
    site = {"a": [["1", "2"], ["3", "2"], ["3", "2"]], "b": [], "c": [["9"], OSError(), ["8"]], "d": [["5"], ["6"], ["7"], []]}

    def get(category, page):
        asked.append((category, page))
        found = site[category][page - 1] if page <= len(site[category]) else []
        if isinstance(found, OSError):
            raise found
        return found

    def reader(pages, most=100):
        r = pages_reader({"categories": "a,b,c,d", "fetcher": "os.path.join", "pages": str(pages), "max_pages": str(most)})
        r.get = get
        return r

    pages_reader = pages.PageStreamReader
    whole, at = reader(100).read(reader(1).initialOffset())
    want, seen = list(whole), list(asked)
    assert want == [("a", 1, "1"), ("a", 1, "2"), ("a", 2, "3"), ("c", 1, "9"), ("d", 1, "5"), ("d", 2, "6"), ("d", 3, "7")]
    assert len(seen) == len(set(seen)) and ("c", 3) not in seen
    asked.clear()
    got, at = [], reader(1).initialOffset()
    for _ in range(20):  # a new reader for each batch, as after a stop; offsets are stored as JSON
        rows, at = reader(2).read(json.loads(json.dumps(at)))
        got += rows
    assert got == want and asked == seen
    middle = reader(3).read(reader(1).initialOffset())[1]
    end = reader(4).read(middle)[1]
    assert list(reader(1).readBetweenOffsets(middle, end)) == list(reader(4).read(middle)[0])
    assert list(reader(100, most=1).read(reader(1).initialOffset())[0]) == [("a", 1, "1"), ("a", 1, "2"), ("c", 1, "9"), ("d", 1, "5")]
