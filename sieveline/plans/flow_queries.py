"""Queries on sources, sinks, mutations, jobs and streams. Files go to the shared folder; small lookups may pass through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as X
from ..operators import changes as D
from ..operators import ranking as R
from ..operators import relational as J
from ..operators import similarity as S
from ..session import scratch, settled
from ..sources import files as FS
from ..sources import pages as H
from ..streaming import jobs as Q
from ..streaming import progress as T
from .catalog import HASHES, Tables, c, query

# ---- sources and sinks ----


def _lookup(df: DataFrame, most: int = 1000) -> list:
    """The rows of a lookup, whose size is checked first."""
    if (n := df.count()) > most:
        raise ValueError(f"{n} rows are no lookup")
    return df.collect()


def _local(path: str) -> str:
    return path.removeprefix("file://")


@query("select n_nationkey, n_name, n_regionkey from nation")
def sqlite_scan(t: Tables) -> DataFrame:
    """A SQLite table read by spans of its rows; the lookup is written on the driver."""
    import os
    import sqlite3

    path = _local(scratch(t.spark, "lookup") + ".db")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with sqlite3.connect(path) as db:
        db.execute("create table nation (n_nationkey integer, n_name text, n_regionkey integer)")
        db.executemany("insert into nation values (?, ?, ?)", [tuple(r) for r in _lookup(t.nation)])
    return FS.read_sqlite(t.spark, path, "nation", "n_nationkey int, n_name string, n_regionkey int", 3)


@query("select * from (values " + ", ".join(f"('{k}', {len(v.split(', '))}, 0)" for k, v in schemas.SCHEMAS.items()) + ") v(name, n_columns, n_rows)")
def bootstrap_twice(t: Tables) -> DataFrame:
    """The tables exist after the first bootstrap, and the second changes nothing."""
    name = scratch(t.spark, "db").rsplit("-", 1)[1]
    db = f"sieveline_{name}"
    t.spark.sql(f"CREATE DATABASE {db} LOCATION '{scratch(t.spark, 'warehouse')}'")
    try:
        schemas.bootstrap(t.spark, db)
        schemas.bootstrap(t.spark, db)
        got = [(x.name, len(t.spark.table(f"{db}.{x.name}").columns), t.spark.table(f"{db}.{x.name}").count()) for x in t.spark.catalog.listTables(db)]  # eleven tables
    finally:
        t.spark.sql(f"DROP DATABASE {db} CASCADE")
    return t.spark.createDataFrame(got, "name string, n_columns int, n_rows int")


_FILES = "select unnest(['region','nation','customer','supplier','part','orders','lineitem','events','documents','embeddings','pages','benchmark','labels','conversations']) as name"


def _named(t: Tables) -> DataFrame:
    """A folder of fourteen small files, one in a folder below."""
    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
    path = scratch(t.spark, "scan")
    rows = t.spark.createDataFrame([(n, n) for n in names], "file string, value string")
    rows.repartition(14, "file").write.partitionBy("file").text(path)
    return FS.scan(t.spark, path, ("txt",))


@query(_FILES)
def folder_scan(t: Tables) -> DataFrame:
    """S3: files of a suffix below a folder."""
    return _named(t).select(F.regexp_extract("path", r"file=(\w+)/", 1).alias("name"))


@query(f"select case when name in ('region','nation','part') then 'already_registered' else 'registered' end status, count(*) n from ({_FILES}) group by 1")
def register_found(t: Tables) -> DataFrame:
    """Found files that a table lacks, with counts."""
    found = _named(t).select(F.regexp_extract("path", r"file=(\w+)/", 1).alias("path"))
    known = t.spark.createDataFrame([("region",), ("nation",), ("part",), ("gone",)], "file_path string")
    return FS.register_files(found, known)[1]


def _archive(t: Tables) -> tuple[str, DataFrame]:
    rows = t.supplier.select(c("s_nationkey").cast("string").alias("source"), c("s_name").alias("name"), F.concat(X.safe_file_name(c("s_name")), F.lit(".ttf")).alias("file_name"), F.when(c("s_suppkey") % 5 != 0, F.concat(F.lit("content of "), "s_name").cast("binary")).alias("content"))
    path = scratch(t.spark, "exports") + "/fonts.zip"
    return path, FS.write_archive(rows, path)


@query("select s_name name, s_nationkey::varchar source, 'content of '||s_name content, (select count(*) from supplier where s_suppkey%5<>0) n_files from supplier where s_suppkey%5<>0")
def archive_round_trip(t: Tables) -> DataFrame:
    """An exported archive with its manifest, imported again."""
    path, made = _archive(t)
    entries, manifest = FS.zip_entries(t.spark, path, ("ttf",), "fonts/"), FS.zip_manifest(t.spark, path, "name: string, source: string, path: string")
    got = FS.import_archives(entries, manifest).select("name", "source", c("content").cast("string").alias("content"))
    return got.join(F.broadcast(made.select("n_files")), F.lit(True))  # one row


@query("select s_name||'.ttf' name, (select count(*) from supplier where s_suppkey%5<>0) n from supplier where s_suppkey%5<>0 and s_suppkey%3<>0")
def archive_extract(t: Tables) -> DataFrame:
    """The entries of an archive that are not there yet, and the count of all."""
    path, _ = _archive(t)
    have = t.supplier.where("s_suppkey % 3 = 0").select(F.concat("s_name", F.lit(".ttf")).alias("name"))
    new, n = FS.extract_new(FS.zip_entries(t.spark, path, ("ttf",)), have)
    return new.select("name").join(F.broadcast(n), F.lit(True))  # one row


@query("select s_suppkey, s_name, s_acctbal from supplier")
def json_results(t: Tables) -> DataFrame:
    """Results as JSON and read back."""
    path = scratch(t.spark, "results")
    FS.save_results(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), path)
    return t.spark.read.schema("s_suppkey bigint, s_name string, s_acctbal double").json(path)


@query("select (select count(*) from nation) fonts, (select count(*) from region) duplicates, 0 removed, (select min(n_name) from nation) first_name")
def catalog_document(t: Tables) -> DataFrame:
    """Lookups as one document of three lists."""
    doc = FS.catalog_json(t.nation.select("n_name"), t.region.select("r_name"), t.region.where("false"))
    d = F.from_json("catalog", "fonts array<struct<n_name: string>>, duplicates array<struct<r_name: string>>, removed array<struct<r_name: string>>")
    return doc.select(d.alias("d")).select(F.size("d.fonts").cast("bigint").alias("fonts"), F.size("d.duplicates").cast("bigint").alias("duplicates"), F.size("d.removed").alias("removed"), F.get("d.fonts", F.lit(0))["n_name"].alias("first_name"))


@query("select lpad((row_number() over (order by vec_id)-1)::varchar, 8, '0') as key, vec_id, label, (select count(*) from embeddings) length from embeddings")
def sample_store(t: Tables) -> DataFrame:
    """Samples by zero-padded keys with a header of their number."""
    path = scratch(t.spark, "samples")
    FS.write_samples(t.embeddings.select("vec_id", "label"), ["vec_id"], path)
    rows, n = FS.read_samples(t.spark, path)
    return rows.select("key", "vec_id", "label", F.lit(n).cast("bigint").alias("length"))


@query("select c_custkey, dense_rank() over (order by c_mktsegment)-1 char_code, dense_rank() over (order by c_nationkey)-1 writer_code from customer")
def dataset_parts(t: Tables) -> DataFrame:
    """Dictionaries of characters and writers, and samples by their codes."""
    path = scratch(t.spark, "dataset")
    FS.write_dataset(t.customer.select("c_custkey", c("c_mktsegment").alias("char"), c("c_nationkey").alias("writer")), path)
    return t.spark.read.parquet(f"{path}/samples").select("c_custkey", "char_code", "writer_code")


@query("select 'F'||n_regionkey font, string_agg(chr(65+n_nationkey::int)||'=M'||n_nationkey||' 0', ',' order by n_nationkey) glyphs from nation group by n_regionkey")
def svg_fonts(t: Tables) -> DataFrame:
    """A folder of SVG fonts as a map of glyphs for each font; glyphs without an outline are left out."""
    path = scratch(t.spark, "fonts")
    glyph = F.concat(F.lit('<glyph unicode="'), F.chr(65 + c("n_nationkey")), F.lit('" horiz-adv-x="500" d="M'), c("n_nationkey").cast("string"), F.lit(' 0"/>'))
    body = t.nation.groupBy("n_regionkey").agg(F.concat_ws("", F.array_sort(F.collect_list(glyph))).alias("g"))
    text = F.concat(F.lit('<svg><font id="F'), c("n_regionkey").cast("string"), F.lit('">'), "g", F.lit('<glyph unicode="z" d=""/></font></svg>'))
    body.select(c("n_regionkey").alias("file"), text.alias("value")).repartition(5, "file").write.partitionBy("file").text(path)
    fonts = H.svg_font_map(H.svg_glyphs(t.spark, f"{path}/*/*.txt"))
    return fonts.select("font", F.array_join(F.transform(F.array_sort(F.map_entries("glyphs")), lambda e: F.concat(e["key"], F.lit("="), e["value"]["d"])), ",").alias("glyphs"))


@query("select vec_id, round(list_sum(embedding::double[]),5) total from embeddings")
def npz_round_trip(t: Tables) -> DataFrame:
    """Arrays in compressed numpy archives of so many each, and read by their index."""
    path = scratch(t.spark, "npz")
    index = FS.write_npz(t.embeddings.select("vec_id", c("embedding").cast("array<double>").alias("embedding")), path, "vec_id", "embedding", 64)
    return FS.read_npz(index, path, "vec_id").select("vec_id", F.round(F.aggregate("values", F.lit(0.0), lambda a, b: a + b), 5).alias("total"))


@query("select r_regionkey*25+n_nationkey idx, case when n_nationkey%4<>0 then n_name end as data, n_nationkey%4<>0 valid, (select count(*) from nation)*2 later from region cross join nation")
def packed_rows(t: Tables) -> DataFrame:
    """A pack by (font, character) places; a second run writes only what the first lacks."""
    fonts, chars = t.region.select(c("r_regionkey").alias("font_idx")), t.nation.select(c("n_nationkey").alias("char_idx"), F.when(c("n_nationkey") % 4 != 0, c("n_name")).alias("data"))
    path = scratch(t.spark, "pack")
    place = lambda f: FS.packed_index(f, chars, 25).select("idx", "data")
    FS.write_pack(place(fonts.where("font_idx < 3")), path)
    later = FS.write_pack(place(fonts), path)
    return t.spark.read.parquet(path).select("idx", "data", "valid", F.lit(later).cast("bigint").alias("later"))


@query("select n_name category, i//3+1 page, 'http://'||n_name||'/'||i url from nation cross join range(0,8) r(i)")
def paged_listing(t: Tables) -> DataFrame:
    """A paged source read by category until a page has nothing new."""
    H.register(t.spark)
    names = [r["n_name"] for r in _lookup(t.nation.select("n_name"))]
    return t.spark.read.format("paged").options(categories=",".join(names), fetcher="sieveline.plans.curation_queries.sample_page", max_pages="9").load()


@query("select c_custkey, case when c_custkey%6<=3 then 200 else 503 end status, case c_custkey%6 when 0 then 0.0 when 1 then 7.0 when 2 then 7.0+2.0 when 3 then 7.0+2.0+4.0 else 7.0+2.0+4.0 end waited from customer")
def fetched_pages(t: Tables) -> DataFrame:
    """Retries by what a server answers: a 429 says how long to wait, other failures wait twice as long each time."""
    return H.fetch_all(t.customer.select("c_custkey", (c("c_custkey") % 6).cast("string").alias("url")), "c_custkey", "url", "sieveline.plans.curation_queries.failing_server").select("c_custkey", "status", "waited")


@query("select s_suppkey, case when s_suppkey%2=0 then 'https://fonts.gstatic.com/s/'||s_suppkey||'.ttf' else '' end url from supplier")
def css_urls(t: Tables) -> DataFrame:
    """S24"""
    css = F.concat(F.lit("@font-face { src: local('x'), url(https://other.example/a.ttf), "), F.when(c("s_suppkey") % 2 == 0, F.concat(F.lit("url(https://fonts.gstatic.com/s/"), c("s_suppkey").cast("string"), F.lit(".ttf)"))).otherwise("none"), F.lit(", url(https://fonts.gstatic.example/z.ttf); }"))
    return t.supplier.select("s_suppkey", H.first_css_url(css, r"fonts\.gstatic\.com").alias("url"))


@query("select p_partkey, p_name as name, 'https://x.example/f/'||replace(p_name,' ','-')||'.font' url, 'https://dl.example/?f='||replace(p_name,' ','_') download_url, p_partkey*1000+7 downloads from part")
def list_entries(t: Tables) -> DataFrame:
    """Entries of list pages with their download addresses and counts."""
    slug = F.replace(c("p_name"), F.lit(" "), F.lit("-"))
    html = F.concat(F.lit('<a href="/f/'), slug, F.lit('.font"><b>'), c("p_name"), F.lit("</b></a> by x, "), F.format_number(c("p_partkey") * 1000 + 7, 0), F.lit(' downloads <a href="/f/q.font">Download</a> 3 downloads <a href="/other">no</a>'))
    return H.list_page(t.part.select("p_partkey", html.alias("html")), "p_partkey", "html", "https://x.example", "https://dl.example/?f=").select("p_partkey", "name", "url", "download_url", "downloads")


@query("select 'run'||user_id%7 run, count(distinct event_id%20) epochs from events group by 1 having count(distinct event_id%20)>=5")
def training_runs(t: Tables) -> DataFrame:
    """S28"""
    paths = t.events.select(F.concat(F.lit("run"), (c("user_id") % 7).cast("string"), F.when(c("event_id") % 2 == 0, "/tracking").otherwise(""), F.lit("/epoch_"), (c("event_id") % 20).cast("string"), F.lit("/a.png")).alias("path"))
    return FS.epoch_runs(paths)


@query("select user_id::varchar as run, epoch_us(max(ts)) newest, row_number() over (order by max(ts) desc, user_id::varchar) pos from events group by user_id")
def newest_runs(t: Tables) -> DataFrame:
    """Runs by the time of their newest file."""
    runs = FS.runs_by_time(t.events.select(F.concat(c("user_id").cast("string"), F.lit("/f.png")).alias("path"), c("ts").cast("timestamp").alias("modificationTime")))
    return R.numbered(runs.withColumn("late", -F.unix_micros("newest")), "late", "pos", "run").select("run", F.unix_micros("newest").alias("newest"), c("pos").cast("bigint").alias("pos"))


@query("select s_suppkey, min(c_custkey) asset_id from supplier join customer on c_name='Customer#'||substr(s_name,10) group by s_suppkey")
def results_by_file(t: Tables) -> DataFrame:
    """Results joined with assets by file name."""
    results = t.supplier.select("s_suppkey", F.concat(F.lit("/data/out/"), F.lit("Customer#"), F.expr("substr(s_name, 10)")).alias("file"))
    assets = t.customer.select(c("c_custkey").alias("id"), F.concat(F.lit("/fonts/"), "c_name").alias("file_path"))
    return J.by_file_name(results, assets).select("s_suppkey", "asset_id")


@query("select d.doc_id, p.i-1 pos, substr('abcde', p.i::int, 1) as char from documents d left join labels l on d.doc_id=l.doc_id left join (select doc_id from labels where toxic=1) r on d.doc_id=r.doc_id cross join range(1,6) p(i) where r.doc_id is null and (l.quality=1 or l.quality is null)")
def corpus_samples(t: Tables) -> DataFrame:
    """The eligible items with every character of a set."""
    items = J.eligible(t.documents, t.labels, t.labels.where("toxic = 1"), "doc_id", c("quality") == 1).select("doc_id")
    return items.select("doc_id", F.posexplode(F.split(F.lit("abcde"), "")).alias("pos", "char"))


# ---- mutations ----


def _characters(t: Tables) -> DataFrame:
    return t.customer.select(c("c_custkey").alias("id"), (c("c_custkey") % 50).alias("asset_id"), F.chr(97 + c("c_custkey") % 26).alias("char"), c("c_name").alias("strokes_raw"), F.when(c("c_custkey") % 3 != 0, c("c_mktsegment")).alias("template_variant"), c("c_nationkey").alias("point_count"))


@query("select c_custkey id, case when c_custkey%50=7 then 'new' else c_name end strokes_raw, case when c_custkey%50=7 then 'v2' when c_custkey%3<>0 then c_mktsegment end template_variant, c_nationkey point_count from customer")
def saved_strokes(t: Tables) -> DataFrame:
    """Of the extra values the variant comes before the point count."""
    return D.save_by_precedence(_characters(t), c("asset_id") == 7, "v2", 99, "new").select("id", "strokes_raw", "template_variant", "point_count")


@query("select c_custkey id, case when c_custkey%50=8 and chr((97+c_custkey%26)::int)='i' then null when c_custkey%3<>0 then c_mktsegment end template_variant, (select count(*) from customer where c_custkey%50=8 and c_custkey%26=8 and c_custkey%3<>0) cleared from customer")
def cleared_cache(t: Tables) -> DataFrame:
    """A cached value of one character of an asset becomes null; and how many had one."""
    rows, n = D.clear_cache(_characters(t), "template_variant", 8, "i")
    return rows.select("id", "template_variant", F.lit(n).cast("bigint").alias("cleared"))


@query("select 100+row_number() over (order by a) id, a asset_id, 3 reason_id, '{\"note\": \"n'||a||'\"}' details from (values (5),(9),(11)) v(a) union all select 100, 4, 1, null")
def rejected_by_client(t: Tables) -> DataFrame:
    """The first item's reason holds for all and is added to the lookup; repeats are left out."""
    removals = t.spark.createDataFrame([(100, 4, 1, None)], "id bigint, asset_id bigint, reason_id bigint, details string")
    reasons = t.spark.createDataFrame([(1, "a", "a"), (2, "b", "b")], "id bigint, code string, description string")
    items = [{"asset_id": 5, "reason": "fresh", "note": "n5"}, {"asset_id": 9, "reason": "a", "note": "n9"}, {"asset_id": 11, "note": "n11"}, {"asset_id": 5, "note": "n5"}]
    return D.reject_by_first_reason(removals, items, reasons)[0].select("id", "asset_id", c("reason_id").cast("int").alias("reason_id"), "details")


@query("select o_orderkey id, case when o_orderkey%10=3 then 'Z' else o_orderstatus end status, case when o_orderkey%10=3 then 1.5 else o_totalprice end price from orders")
def updated_columns(t: Tables) -> DataFrame:
    """Any columns of the rows that match."""
    jobs = t.orders.select(c("o_orderkey").alias("id"), c("o_orderstatus").alias("status"), c("o_totalprice").alias("price"))
    return D.update(jobs, c("id") % 10 == 3, {"status": "Z", "price": 1.5})


_JOBS = "select o_orderkey id, case o_orderstatus when 'O' then 'pending' when 'P' then 'running' else 'completed' end status from orders"


def _jobs(t: Tables) -> DataFrame:
    return t.orders.select(c("o_orderkey").alias("id"), F.when(c("o_orderstatus") == "O", "pending").when(c("o_orderstatus") == "P", "running").otherwise("completed").alias("status"))


@query(f"select id, case when id in (select id from ({_JOBS}) where status in ('pending','running') and id in (1,2,3)) then 'cancelled' else status end status from ({_JOBS})")
def cancelled_jobs(t: Tables) -> DataFrame:
    """Only a pending or running job can be cancelled."""
    jobs = _jobs(t)
    for job in (1, 2, 3):
        jobs = D.cancel(jobs, job)
    return jobs


@query("select id, job_id, url, status from (select p_partkey id, 1 job_id, p_name||p_partkey url, 'completed' status from part where p_partkey<30 union all select (select max(p_partkey) from part where p_partkey<30)+row_number() over (order by url), 1, url, 'pending' from (select distinct p_name||p_partkey url from part where p_partkey>=30))")
def staged_items(t: Tables) -> DataFrame:
    """Discovered items are appended as pending, those that the job has are left out."""
    url = F.concat("p_name", c("p_partkey").cast("string"))
    old = t.part.where("p_partkey < 30").select(c("p_partkey").alias("id"), F.lit(1).cast("bigint").alias("job_id"), url.alias("url"), F.lit("completed").alias("status"))
    found = t.part.where("p_partkey >= 20").select(url.alias("url"))
    return D.stage(old, found.union(found), 1).select("id", c("job_id").cast("int").alias("job_id"), "url", "status")


@query("select c_custkey id, case c_custkey when 5 then 'completed' when 6 then 'failed' when 7 then 'completed' else 'pending' end status, case c_custkey when 5 then '/a' when 7 then '/b' end file_path, case c_custkey when 6 then 'gone' end error_message from customer")
def transitions(t: Tables) -> DataFrame:
    """A new status with the path if there is one, else with the error."""
    s = t.customer.select(c("c_custkey").alias("id"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("string").alias("error_message"))
    return D.transition(D.transition(D.transition(s, 5, "completed", "/a"), 6, "failed", None, "gone"), 7, "completed", "/b", "late")


@query("select r_regionkey+1 id, r_name as name, 's' source, '/p/'||r_name file_path from region union all select 5+row_number() over (order by f), n, 's2', f from (select min(n) n, f from (select n_name n, '/p/'||n_name f from nation) group by f)")
def registered_variants(t: Tables) -> DataFrame:
    """New by (name, source), then by path; the first of each path."""
    old = t.region.select((c("r_regionkey") + 1).cast("bigint").alias("id"), c("r_name").alias("name"), F.lit("s").alias("source"), F.concat(F.lit("/p/"), "r_name").alias("file_path"))
    new = t.nation.select(c("n_name").alias("name"), F.lit("s2").alias("source"), F.concat(F.lit("/p/"), "n_name").alias("file_path"))
    again = t.region.select(c("r_name").alias("name"), F.lit("s").alias("source"), F.lit("/other").alias("file_path"))
    same_path = t.region.select(F.lit("zz").alias("name"), F.lit("s3").alias("source"), F.concat(F.lit("/p/"), "r_name").alias("file_path"))
    return D.register_variant(old, new.union(new).union(again).union(same_path))


@query("select 'assets' as name, 0 n union all select 'removals', 0 union all select 'removal_reasons', (select count(*) from region) union all select 'jobs', 0 union all select 'staged', 0")
def emptied_tables(t: Tables) -> DataFrame:
    """All tables empty but the lookup."""
    full = {"assets": t.part, "removals": t.orders, "removal_reasons": t.region, "jobs": t.customer, "staged": t.lineitem}
    each = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, d in D.reset(full).items()]
    out = each[0]
    for d in each[1:]:
        out = out.union(d)
    return out


@query("select 8 id, 3 asset_id, '2024-01-02' run_date, count(*)::int chars_tested, (count(*) filter (event_type<>'error'))::int chars_ok, round(avg(value) filter (event_type<>'error'),6) avg_score, count(*)::int n_results from events where user_id=3")
def saved_run(t: Tables) -> DataFrame:
    """A test run is appended with the counts and means of its results."""
    runs = t.spark.createDataFrame([(7, 1, "2024-01-01")], "id bigint, asset_id bigint, run_date string")
    e = t.events.where("user_id = 3").select(c("event_id").cast("string").alias("char"), F.when(c("event_type") == "error", "error").otherwise("ok").alias("status"), *[c("value").alias(m) for m in ("score", "coverage", "overshoot", "stroke_count", "topology")])
    full = runs.select("*", *[F.lit(None).cast(k).alias(n) for n, k in (("chars_tested", "int"), ("chars_ok", "int"), ("avg_score", "double"), ("results_json", "string"))])
    done = D.save_run(full, 3, e, "2024-01-02").where("asset_id = 3")
    results = F.size(F.from_json("results_json", "array<struct<char: string>>"))
    return done.select("id", "asset_id", "run_date", "chars_tested", "chars_ok", F.round("avg_score", 6).alias("avg_score"), results.alias("n_results"))


@query("select (select count(*) from nation) nations, (select count(*) from region) regions, true rolled_back")
def transactions(t: Tables) -> DataFrame:
    """Two tables become current together, and neither when the block fails."""
    folder, failed = scratch(t.spark, "db"), False
    with D.together(t.spark, folder) as new:
        new["nation"], new["region"] = t.nation, t.region
    try:
        with D.together(t.spark, folder) as new:
            new["nation"] = t.nation.limit(1)
            raise RuntimeError("rolled back")
    except RuntimeError:
        failed = True
    with D.together(t.spark, folder) as new:
        new["region"] = t.spark.read.parquet(D.versions(t.spark, folder)["region"])
    now = {n: t.spark.read.parquet(p) for n, p in D.versions(t.spark, folder).items()}
    a, b = now["nation"].agg(F.count("*").alias("nations")), now["region"].agg(F.count("*").alias("regions"))
    return a.join(b, F.lit(True)).select("nations", "regions", F.lit(failed).alias("rolled_back"))  # one row each


@query("select c_custkey id, case when c_custkey%2=0 then 'x' else c_name end as name, c_custkey%2=0 touched from customer")
def touched_rows(t: Tables) -> DataFrame:
    """an update notes its time in the rows it changes; a null value changes nothing else."""
    rows = t.customer.select(c("c_custkey").alias("id"), c("c_name").alias("name"), F.lit(None).cast("timestamp").alias("updated_at"))
    done = D.touched(rows, c("id") % 2 == 0, {"name": "x", "id": None})
    return done.select("id", "name", (c("updated_at") >= F.current_timestamp() - F.expr("interval 1 day")).alias("stamped"), c("updated_at").isNotNull().alias("touched")).select("id", "name", "touched")


# ---- jobs and streams ----


@query("with o as (select row_number() over (order by event_id) checked, event_type='error' bad from events), s as (select *, sum(bad::int) over (order by checked) failed from o) select checked seq, 'progress' as type, checked, failed, (failed//50*50) rejected from s where bad and failed%50=0 or checked%100=0 union all select count(*)+1, 'done', count(*), sum(bad::int), sum(bad::int) from o")
def rejection_progress(t: Tables) -> DataFrame:
    """Progress of a rejection in batches of fifty failed rows, at every hundredth row, and the end."""
    q = Q.rejection_frames(t.events, "event_id", c("event_type") == "error", 50, 100)
    return q.select("seq", "type", "checked", c("failed").cast("decimal(38,0)").alias("failed"), c("rejected").cast("decimal(38,0)").alias("rejected"))


@query("select event_id, user_id from events where event_type='error'")
def rejected_in_batches(t: Tables) -> DataFrame:
    """The removals of a stream, appended batch by batch."""
    source, out = scratch(t.spark, "events"), scratch(t.spark, "removals")
    t.events.repartition(6).write.parquet(source)
    stream = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 2).parquet(source)
    Q.reject_in_batches(stream, c("event_type") == "error", lambda d: d.select("event_id", "user_id"), out, scratch(t.spark, "checkpoint")).awaitTermination()
    return t.spark.read.parquet(f"{out}/batch=*").select("event_id", "user_id")


_GREEDY = (
    f"with recursive h as (select h, min(vec_id) born from ({HASHES}) group by h), o as (select *, row_number() over (order by born) k from h), "
    "g(k, leaders) as (select 0::bigint, []::hugeint[] union all select g.k+1, case when len(list_filter(leaders, lambda x: bit_count(xor(x, o.h))<=14))>0 then leaders else list_append(leaders, o.h) end from g join o on o.k=g.k+1), "
    "l as (select unnest(leaders) h from g where k=(select max(k) from g)), lead as (select o.born, o.h from l join o using (h)), "
    f"own as (select o.h, min(lead.born) leader from o join lead on bit_count(xor(lead.h,o.h))<=14 and lead.born<=o.born group by o.h), m as (select own.leader, v.vec_id member from ({HASHES}) v join own on own.h=v.h), "
    "gr as (select leader, count(*) n from m group by 1 having count(*)>1), n as (select count(*) total from embeddings), b as (select count(*) g, coalesce(sum(n-1),0) d from gr) "
)


@query(
    _GREEDY + "select 0 seq, 'data: {\"status\":\"starting\",\"total\":'||total||'}'||chr(10)||chr(10) frame from n union all select rn, 'data: {\"status\":\"hashing\",\"name\":\"v'||lpad(vec_id::varchar,9,'0')||'\",\"current\":'||rn||',\"total\":'||total||'}'||chr(10)||chr(10) from (select vec_id, row_number() over (order by vec_id) rn from embeddings) cross join n where rn%5=0 or rn=total "
    "union all select total+1, 'data: {\"status\":\"analyzing\"}'||chr(10)||chr(10) from n union all select total+2, 'data: {\"status\":\"complete\",\"total_groups\":'||g||',\"total_duplicates\":'||d::bigint||'}'||chr(10)||chr(10) from n cross join b"
)
def duplicate_stream(t: Tables) -> DataFrame:
    """The frames of a duplicate search."""
    h = S.difference_hash(t.embeddings, "vec_id", "embedding", 63).withColumn("name", F.concat(F.lit("v"), F.lpad(c("vec_id").cast("string"), 9, "0")))
    return Q.duplicate_frames(h, "vec_id", "name", "h", 14, 5)


def _reader(key: int) -> str:
    if key % 7 == 0:
        raise OSError("Download failed")
    return f"/files/{key}"


_WORKED = "select c_custkey id, case when c_custkey%7=0 then 'failed' else 'completed' end status, case when c_custkey%7<>0 then '/files/'||c_custkey end file_path, case when c_custkey%7=0 then 'Download failed' end error from customer"


def _queue(t: Tables, **how) -> Q.DownloadQueue:
    found = scratch(t.spark, "discovered")
    t.customer.select(c("c_custkey").alias("id")).repartition(5).write.json(found)
    return Q.DownloadQueue(t.spark, found, "id bigint", scratch(t.spark, "results"), scratch(t.spark, "checkpoint"), _reader, "id", ("id",), **how)


@query(_WORKED)
def download_queue(t: Tables) -> DataFrame:
    """Discovered items worked off by workers; failures are reported in their rows."""
    q = _queue(t).start(2)
    q.wait()
    if q.status != "completed":
        raise RuntimeError(q.status)
    return q.done().select("id", "status", "file_path", "error")


@query(_WORKED)
def paused_queue(t: Tables) -> DataFrame:
    """A queue that is paused, resumed and finished has worked off each item; what is over cannot be cancelled."""
    q = _queue(t).start(1)
    if q.pause():
        q.resume()
    q.wait()
    if q.cancel() or q.status != "completed":
        raise RuntimeError(q.status)
    return q.done().select("id", "status", "file_path", "error")  # an item worked off twice would be here twice


@query("select r_name category, r_regionkey pos from region where r_regionkey>=2")
def resumed_categories(t: Tables) -> DataFrame:
    """T9"""
    return T.resumable(t.region.select(c("r_name").alias("category"), c("r_regionkey").alias("pos")), 2)


@query("select n_name url, case when n_nationkey%7=0 then 'failed' else 'completed' end status from nation where n_regionkey>=1 and n_nationkey%5<>4")
def scraped_categories(t: Tables) -> DataFrame:
    """Categories one after the other, each leaving out what is known."""
    names = [r["r_regionkey"] for r in _lookup(t.region.select("r_regionkey").orderBy("r_regionkey"))]
    discover = lambda k: t.nation.where(c("n_regionkey") == int(k)).select(c("n_name").alias("url"), "n_nationkey")
    download = lambda d: d.select("url", F.when(c("n_nationkey") % 7 == 0, "failed").otherwise("completed").alias("status"))
    return Q.scrape_categories([str(n) for n in names], discover, download, t.nation.where("n_nationkey % 5 = 4").select(c("n_name").alias("url")), "url", 1)[0]


@query("with k as (select r_regionkey k, count(n_nationkey) filter (n_nationkey%5<>4) n, count(n_nationkey) filter (n_nationkey%5<>4 and n_nationkey%7=0) bad from region left join nation on n_regionkey=r_regionkey group by 1) select k::varchar category, 'scrape_start' event, 0 n from k union all select k::varchar, 'scrape_complete', n from k union all select k::varchar, e, case e when 'download_success' then n-bad when 'download_fail' then bad else n end from k cross join (select unnest(['download_start','download_success','download_fail','download_complete']) e) where n>0 union all select 'broken: no such category', 'error', 0 union all select 'broken', 'scrape_start', 0")
def scraping_events(t: Tables) -> DataFrame:
    """The events of scraping, an error of discovery among them."""
    names = [str(r["r_regionkey"]) for r in _lookup(t.region.select("r_regionkey"))]

    def discover(k: str) -> DataFrame:
        if k == "broken":
            raise ValueError("no such category")
        return t.nation.where(c("n_regionkey") == int(k)).select(c("n_name").alias("url"), "n_nationkey")

    download = lambda d: d.select("url", F.when(c("n_nationkey") % 7 == 0, "failed").otherwise("completed").alias("status"))
    events = Q.scrape_categories([*names, "broken"], discover, download, t.nation.where("n_nationkey % 5 = 4").select(c("n_name").alias("url")))[1]
    return t.spark.createDataFrame(events, "event string, category string, n int").select("category", "event", "n")


@query("select c_custkey as key, c_custkey%7<>0 success, case when c_custkey%7<>0 then '/files/'||c_custkey end as value, case when c_custkey%7=0 then 'Download failed' end error from customer")
def parallel_items(t: Tables) -> DataFrame:
    """A function on each row, failures reported in their rows."""
    return S.parallel_map(t.customer, "c_custkey", _reader, ["c_custkey"])


@query("select event_id from (select event_id from events order by event_id desc limit 20) order by event_id")
def polled_log(t: Tables) -> DataFrame:
    """A poll of a growing log gives the newest lines, oldest first."""
    source, out = scratch(t.spark, "log"), scratch(t.spark, "tail")
    t.events.coalesce(1).write.parquet(source)
    stream = t.spark.readStream.schema(t.events.schema).parquet(source)
    Q.log_poll(stream.select("event_id"), "event_id", 20, lambda d: d.write.mode("overwrite").parquet(out), scratch(t.spark, "checkpoint")).awaitTermination()
    return t.spark.read.parquet(out)


@query("select distinct user_id from events")
def seen_keys(t: Tables) -> DataFrame:
    """The first row of each key of a stream."""
    source, out = scratch(t.spark, "pages"), scratch(t.spark, "unique")
    t.events.repartition(4).write.parquet(source)
    stream = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    T.unique_stream(stream.select("user_id"), "user_id").writeStream.option("checkpointLocation", scratch(t.spark, "checkpoint")).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    return t.spark.read.parquet(out)


@query("select user_id, count(*) checked, count(*) filter (event_type='error') failed from events group by 1")
def stream_counters(t: Tables) -> DataFrame:
    """Running counters of a stream held as state; the last of each job."""
    source, out = scratch(t.spark, "jobs"), scratch(t.spark, "counters")
    t.events.repartition(3).write.parquet(source)
    stream = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(source).withColumn("bad", c("event_type") == "error")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    T.running_counts(stream, "user_id", "bad").writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", scratch(t.spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{out}/batch=*").groupBy("user_id").agg(F.max("checked").alias("checked"), F.max("failed").alias("failed"))


@query("select user_id, count(*) lines, max(event_id)-min(event_id) done, round((1000000-max(event_id))*(epoch_us(max(ts))-epoch_us(min(ts)))/1e6/nullif(max(event_id)-min(event_id),0),1) eta from (select * from events where event_type in ('click','view')) group by user_id")
def log_eta(t: Tables) -> DataFrame:
    """Progress and time left by the first and last progress lines of each session's log."""
    line = F.concat(F.lit("step "), c("event_id").cast("string"), F.lit("/1000000 loss 0.1"))
    logs = t.events.select("user_id", "ts", F.when(c("event_type").isin("click", "view"), line).otherwise("noise").alias("message"))
    return R.progress_of_logs(logs, "user_id", "ts", "message").select("user_id", "lines", "done", F.round("eta", 1).alias("eta"))


@query("select user_id, count(*) n_frames from (select user_id, row_number() over (partition by user_id order by event_id) rn, count(*) over (partition by user_id) n from events), (select unnest(['start','progress','done']) k) where k='start' and rn=1 or k='progress' and rn%10=0 or k='done' and rn=n group by 1")
def verification_frames(t: Tables) -> DataFrame:
    """Start, every tenth progress and done of each job as frames."""
    counters = T.progress(t.events.withColumn("bad", c("event_type") == "error"), "user_id", "event_id", "bad")
    return T.progress_frames(counters, "user_id", "event_id", 10).groupBy("user_id").agg(F.count("*").alias("n_frames"))


def _probabilities(t: Tables) -> Column:
    return X.softmax(c("embedding").cast("array<double>"))


@query("select vec_id, string_agg(i::varchar, ',' order by v desc, lpad(i::varchar,2,'0')) top from (select vec_id, i, embedding[i+1] v, row_number() over (partition by vec_id order by embedding[i+1] desc, lpad(i::varchar,2,'0')) rn from embeddings cross join range(0,64) r(i)) where rn<=3 group by vec_id")
def top_classes(t: Tables) -> DataFrame:
    """The three likeliest classes."""
    labels = F.array(*[F.lit(f"{i:02d}") for i in range(64)])
    top = X.top_classes(_probabilities(t), labels, 3)
    return t.embeddings.select("vec_id", F.array_join(F.transform(top, lambda p: p["label"].cast("int").cast("string")), ",").alias("top"))


@query("select vec_id, round(greatest(p[27+label%26], p[1+label%26]),6) confidence, greatest(p[27+label%26], p[1+label%26])>=0.016 accepted from (select vec_id, label, [exp(x)/list_sum([exp(y::double) for y in embedding]) for x in embedding::double[]] p from embeddings)")
def letter_confidence(t: Tables) -> DataFrame:
    """The probability of a letter in the case that is likelier."""
    p = _probabilities(t)
    m = F.map_from_arrays(F.array(*[F.lit(chr(k + i)) for k in (65, 97) for i in range(26)]), F.slice(p, 1, 52))
    best = X.case_probability(m, F.chr(97 + c("label") % 26))
    return t.embeddings.select("vec_id", F.round(best, 6).alias("confidence"), (best >= 0.016).alias("accepted"))


@query("select event_id, coalesce(cast(json_extract(props,'$.k') as bigint),-1) k, 'none' other, coalesce(case when event_id%3=0 then 'deep'||event_id end,'empty') inner_value from events")
def nested_defaults(t: Tables) -> DataFrame:
    """values of nested maps with defaults."""
    m = F.from_json("props", "map<string,string>")
    nested = F.map_from_arrays(F.array(F.lit("a")), F.array(F.when(c("event_id") % 3 == 0, F.map_from_arrays(F.array(F.lit("b")), F.array(F.concat(F.lit("deep"), c("event_id").cast("string")))))))
    return t.events.select("event_id", X.get_or(m, "-1", "k").cast("bigint").alias("k"), X.get_or(m, "none", "zz").alias("other"), X.get_or(nested, "empty", "a", "b").alias("inner_value"))


@query("select o_orderkey, case when o_totalprice<10000 then 'price='||round(o_totalprice,0)::bigint||'|' else '' end || case when o_orderpriority='5-LOW' then 'low|' else '' end labels from orders")
def issue_labels(t: Tables) -> DataFrame:
    """One label for each rule that a row breaks."""
    rules = F.array_compact(F.array(F.when(c("o_totalprice") < 10000, F.concat(F.lit("price="), F.round("o_totalprice", 0).cast("bigint").cast("string"))), F.when(c("o_orderpriority") == "5-LOW", "low")))
    return t.orders.select("o_orderkey", F.array_join(F.transform(rules, lambda v: F.concat(v, F.lit("|"))), "").alias("labels"))


@query("select r_name source, count(*) n, 'done' status from nation join region on n_regionkey=r_regionkey group by 1 union all select 'missing', 0, 'no adapter'")
def adapters(t: Tables) -> DataFrame:
    """Pluggable sources by name, each a function to a frame; unknown names are reported."""
    registry = Q.Adapters()
    for name, key in [(r["r_name"], r["r_regionkey"]) for r in _lookup(t.region)]:
        registry.add(name, lambda k=key: t.nation.where(c("n_regionkey") == k).select(c("n_name").alias("url")))
    return registry.run([*registry.names(), "missing"], lambda d: settled(d, "scraped").count(), t.spark)


@query("select n_name family, n_regionkey category, 1 asked from nation")
def api_listing(t: Tables) -> DataFrame:
    """The rows of a guarded JSON answer that a process asks for once."""
    import json
    import uuid

    asked, name = [], uuid.uuid4().hex

    def load() -> str:
        asked.append(1)
        rows = [{"family": r["n_name"], "category": r["n_regionkey"]} for r in _lookup(t.nation)]
        return ")]}'\n" + json.dumps({"familyMetadataList": rows})

    for _ in range(3):
        text = H.answered_once(name, load)
    return H.api_rows(t.spark, text, "familyMetadataList", "family: string, category: int").withColumn("asked", F.lit(len(asked)))
