"""Queries of the curation operators on the given tables: bootstraps, folders, batches, matching, clusters, indexes, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import points as P
from ..functions import text as X
from ..operators import changes as D
from ..operators import ranking as R
from ..operators import spatial as G
from ..session import scratch, settled
from ..sources import files as FS
from ..sources import pages as H
from .catalog import POINTS, TURNS, Tables, _turns, c, query

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PIX = "select vec_id, (i-1)%8 x, (i-1)//8 y from embeddings cross join range(1,65) r(i) where embedding[i]>0"


def sample_page(category: str, page: int) -> list[str]:
    """Stands for a site in queries: a listing of eight urls on pages of three; later pages say the last one again."""
    urls = [f"http://{category}/{i}" for i in range(8)]
    return urls[3 * page - 3 : 3 * page] or urls[6:]


def failing_server(url: str, attempt: int) -> tuple[int, dict[str, str], bytes]:
    """Stands for a server in queries: answers 429 once, then 503, as often as the number that the url ends with says."""
    if attempt >= int(url.rsplit("#", 1)[-1]):
        return 200, {}, b"ok"
    return (429, {"Retry-After": "7"}, b"") if attempt == 0 else (503, {}, b"")


# ---- sources ----


@query("select 'asset' kind, page_id id, url value from pages union all select 'reason', row_number() over (order by event_type), event_type from (select distinct event_type from events)")
def bootstrapped_rows(t: Tables) -> DataFrame:
    """Tables are created, filled and created again; the lookup is seeded twice; nothing is lost and nothing is there twice."""
    db = "sieveline_" + scratch(t.spark, "db").rsplit("-", 1)[1]
    t.spark.sql(f"CREATE DATABASE {db} LOCATION '{scratch(t.spark, 'warehouse')}'")
    try:
        schemas.bootstrap(t.spark, db)
        assets = schemas.empty(t.spark, "assets").unionByName(t.pages.select(c("page_id").alias("id"), "url"), allowMissingColumns=True)
        assets.write.insertInto(f"{db}.assets")
        seeds = t.events.select(c("event_type").alias("code"), c("event_type").alias("description")).distinct()
        seeds = seeds.select(F.lit(None).cast("bigint").alias("id"), "code", "description")
        for _ in range(2):
            known = t.spark.table(f"{db}.removal_reasons")
            seeded = settled(D.insert_or_ignore(known, seeds, ["code"]).join(known.select("code"), "code", "left_anti"), "seeds")
            seeded.select("id", "code", "description").write.insertInto(f"{db}.removal_reasons")
            schemas.bootstrap(t.spark, db)
        rows = t.spark.table(f"{db}.assets").select(F.lit("asset").alias("kind"), "id", c("url").alias("value"))
        return settled(rows.union(t.spark.table(f"{db}.removal_reasons").select(F.lit("reason"), "id", "code")), "bootstrapped")
    finally:
        t.spark.sql(f"DROP DATABASE {db} CASCADE")


def _folders(t: Tables) -> str:
    """The documents as text files, a folder for each language and source."""
    path = scratch(t.spark, "folders")
    rows = t.documents.select("lang", "source", F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ").alias("value"))
    rows.repartition("lang", "source").write.partitionBy("lang", "source").text(path)
    return path


@query("select distinct 'lang='||lang||'/source='||source place from documents")
def scanned_folders(t: Tables) -> DataFrame:
    """S3: the folders in which files of a suffix lie, at any depth."""
    return FS.scan(t.spark, _folders(t), ("txt",)).select(F.regexp_extract("path", "(lang=[^/]+/source=[^/]+)/[^/]+$", 1).alias("place")).distinct()


@query("select case when lang='en' then 'already_registered' else 'registered' end status, count(*) n from (select distinct lang, source from documents) group by 1")
def registered_folders(t: Tables) -> DataFrame:
    """Found files that a table lacks, with counts; the table knows those of one language."""
    found = FS.scan(t.spark, _folders(t), ("txt",)).select(F.regexp_extract("path", "(lang=[^/]+/source=[^/]+)/[^/]+$", 1).alias("path")).distinct()
    known = t.documents.where("lang = 'en'").select(F.concat(F.lit("lang=en/source="), "source").alias("file_path"))
    return FS.register_files(found, known)[1]


@query("select page_id, case when length(url)%6<=3 then 200 else 503 end status, case length(url)%6 when 0 then 0.0 when 1 then 7.0 when 2 then 9.0 else 13.0 end waited from pages where url is not null")
def fetched_urls(t: Tables) -> DataFrame:
    """Each page's url, asked for until it answers or three more tries have failed; the server is a function."""
    asked = t.pages.where("url is not null").select("page_id", F.concat_ws("#", "url", (F.length("url") % 6).cast("string")).alias("url"))
    return H.fetch_all(asked, "page_id", "url", "sieveline.plans.curation_queries.failing_server").select("page_id", "status", "waited")


def _customers(t: Tables, *where: tuple) -> DataFrame:
    """The customers that meet conditions, from a table of a database file."""
    path = scratch(t.spark, "customers") + ".db"
    rows = t.customer.select("c_custkey", "c_name", "c_nationkey", c("c_acctbal").cast("double").alias("c_acctbal"))
    FS.write_sqlite(rows, path, "customer")
    return FS.read_sqlite(t.spark, path, "customer", "c_custkey long, c_name string, c_acctbal double", 4, where)


@query("select c_custkey, c_name, c_acctbal::double c_acctbal from customer where c_nationkey in (3,7,11) and c_acctbal>100")
def database_rows(t: Tables) -> DataFrame:
    """A table of a database file, read by spans of its rows; conditions are evaluated where the file is read."""
    return _customers(t, ("c_nationkey", "in", [3, 7, 11]), ("c_acctbal", ">", 100))


@query("select o_orderkey, c_name from orders join customer on c_custkey=o_custkey where c_custkey=8 and c_name>='C'")
def database_lookup(t: Tables) -> DataFrame:
    """A row of a database file by its key, joined to a table."""
    one = _customers(t, ("c_custkey", "=", 8), ("c_name", ">=", "C"))
    return t.orders.join(one, c("o_custkey") == c("c_custkey")).select("o_orderkey", "c_name")


@query("select 'c'||(page_id%5) category, 1+(row_number() over (partition by page_id%5 order by page_id)-1)//10 page, url from pages where url is not null")
def resumed_pages(t: Tables) -> DataFrame:
    """Listings of the pages' urls, ten to a page, read by a stream that pauses in the middle and goes on at the next page."""
    from ..streaming.jobs import PagedJob

    rows = t.pages.where("url IS NOT NULL").select(F.concat(F.lit("c"), (c("page_id") % 5).cast("string")).alias("category"), "page_id", "url")
    page = F.expr("1 + (row_number() OVER (PARTITION BY category ORDER BY page_id) - 1) div 10")
    base = scratch(t.spark, "listing")
    H.write_listing(rows.select("category", "page_id", "url", page.cast("int").alias("page")), base, "page_id")
    job = PagedJob(t.spark, scratch(t.spark, "paged"), scratch(t.spark, "paged-checkpoint"), {"categories": "c0,c1,c2,c3,c4", "fetcher": "sieveline.sources.pages.page_of_listing", "base": base, "pages": "7", "max_pages": "100000"})
    job.run(2)  # and here it pauses
    job.run()
    return job.found()


# ---- mutations ----


@query(
    "with first as (select o_orderpriority code from orders order by o_orderkey limit 1), ids as (select o_custkey asset_id, arg_min(o_orderkey::varchar, o_orderkey) details from orders group by 1), "
    "old as (select c_custkey asset_id, row_number() over (order by c_custkey) id from customer where c_nationkey=3), top as (select coalesce(max(id),0) m from old) "
    "select id, asset_id, 1 reason_id, null details from old union all select m+row_number() over (order by asset_id), asset_id, (select max(n_nationkey)+1 from nation), details from ids, top"
)
def rejected_in_batch(t: Tables) -> DataFrame:
    """The first order's priority is the reason of all, added to the lookup; each customer is rejected once, with the first order as detail."""
    reasons = t.nation.select(c("n_nationkey").cast("bigint").alias("id"), c("n_name").alias("code"), c("n_name").alias("description"))
    old = R.numbered(t.customer.where("c_nationkey = 3").select(c("c_custkey").cast("bigint").alias("asset_id")), "asset_id", "id")
    removals = old.select(c("id").cast("bigint").alias("id"), "asset_id", F.lit(1).cast("bigint").alias("reason_id"), F.lit(None).cast("string").alias("details"))
    items = t.orders.select(c("o_orderkey").alias("pos"), c("o_custkey").cast("bigint").alias("asset_id"), c("o_orderpriority").alias("reason"), c("o_orderkey").cast("string").alias("details"))
    return D.reject_batch(removals, items, reasons)[0].select("id", "asset_id", c("reason_id").cast("int").alias("reason_id"), "details")


# ---- matching, clusters, indexes ----


@query(
    "with recursive w as (select s_suppkey k, (s_acctbal/10)::int v, row_number() over (order by s_suppkey) n from supplier), a as (select c_custkey item, (c_acctbal/10)::int v from customer), "
    "near as (select n, k, item, abs(a.v-w.v) gap, a.v from w join a on abs(a.v-w.v)<=5), lists as (select w.n, w.k, coalesce(list(near.item order by gap, near.v, near.item) filter (near.item is not null), []) l from w left join near using (n) group by 1, 2), "
    "g(n, k, item, used) as (select 0::bigint, 0::bigint, null::bigint, []::bigint[] union all select l.n, l.k, list_filter(l.l, lambda x: not list_contains(g.used, x))[1], case when list_filter(l.l, lambda x: not list_contains(g.used, x))[1] is null then g.used else list_append(g.used, list_filter(l.l, lambda x: not list_contains(g.used, x))[1]) end from g join lists l on l.n=g.n+1) "
    "select g.k s_suppkey, g.item c_custkey, abs((c_acctbal/10)::int-(s_acctbal/10)::int) gap from g join supplier on s_suppkey=g.k join customer on c_custkey=g.item"
)
def matched_without_reuse(t: Tables) -> DataFrame:
    """Each supplier with the customer of nearest balance within five, none taken twice, suppliers in order."""
    ten = lambda v: F.rint(c(v) / 10).cast("int")  # noqa: E731  halves to the even number
    wishes, items = t.supplier.select("s_suppkey", ten("s_acctbal").alias("v")), t.customer.select("c_custkey", ten("c_acctbal").alias("v"))
    return R.nearest_available(wishes, items, "s_suppkey", "v", "c_custkey", 5)


@query(
    f"with recursive p as ({PIX}), d as (select a.vec_id, a.x, a.y, a.y*8+a.x id from p a join p b on b.vec_id=a.vec_id and abs(a.x-b.x)<=1 and abs(a.y-b.y)<=1 and (a.x<>b.x or a.y<>b.y) group by 1,2,3 having count(*)>=3), "
    "r(vec_id, id, to_id) as (select vec_id, id, id from d union select r.vec_id, r.id, b.id from r join d a on a.vec_id=r.vec_id and a.id=r.to_id join d b on b.vec_id=a.vec_id and (a.x-b.x)**2+(a.y-b.y)**2<=4) "
    "select vec_id, id, min(to_id) cluster from r group by 1,2"
)
def junction_groups(t: Tables) -> DataFrame:
    """Junction pixels of each mask, in clusters of steps of two pixels at most."""
    ink = t.embeddings.select(c("vec_id").alias("glyph"), F.posexplode("embedding").alias("i", "v")).where("v > 0").select("glyph", (c("i") % 8).alias("x"), F.expr("CAST(i div 8 AS int)").alias("y"))
    joints = settled(G.pixel_kinds(ink, G.adjacency(ink)).where("kind = 'junction'").select("glyph", (c("y") * 8 + c("x")).alias("id"), "x", "y"), "junctions")
    return G.radius_clusters(joints, 2.0).select(c("glyph").alias("vec_id"), "id", "cluster")


@query(
    f"with e as (select vec_id, s, side, xs[4*s+1+3*side] x, ys[4*s+1+3*side] y from ({POINTS}) cross join range(0,8) a(s) cross join range(0,2) b(side)), "
    "q as (select a.vec_id, a.s s1, b.s s2, a.side side1, b.side side2, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) d from e a join e b on a.vec_id=b.vec_id and a.s<b.s) "
    "select vec_id, s1::int stroke1, s2::int stroke2, side1::int side1, side2::int side2, round(d,6) d from q qualify row_number() over (partition by vec_id order by d, s1, s2, side1, side2)=1"
)
def closest_stroke_ends(t: Tables) -> DataFrame:
    """Of eight strokes of four points the two ends that come closest, in any of the four ways round."""
    p = t.embeddings.select(c("vec_id").alias("glyph"), P.from_pairs(c("embedding")).alias("p"))
    one = F.struct(F.lit(0).alias("side")), F.struct(F.lit(1).alias("side"))
    ends = p.select("glyph", "p", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("stroke")).select("glyph", "stroke", "p", F.explode(F.array(*one)).alias("o")).select("glyph", "stroke", c("o.side").alias("side"), F.get("p", 4 * c("stroke") + 3 * c("o.side")).alias("q"))
    found = G.closest_ends(ends.select("glyph", "stroke", "side", "q.x", "q.y"))
    return found.select(c("glyph").alias("vec_id"), "stroke1", "stroke2", "side1", "side2", F.round("d", 6).alias("d"))


@query("select s_nationkey, arg_min(s_suppkey, [(s_acctbal-1000)*(s_acctbal-1000)+(s_suppkey-50.0)*(s_suppkey-50.0), s_acctbal, s_suppkey]) s_suppkey from supplier group by 1")
def closest_to_place(t: Tables) -> DataFrame:
    """The point of each group nearest to a place."""
    near = G.closest_point(t.supplier.select("s_nationkey", c("s_acctbal").alias("x"), c("s_suppkey").cast("double").alias("y")), 1000.0, 50.0, "s_nationkey")
    return near.select("s_nationkey", c("y").cast("bigint").alias("s_suppkey"))


@query("select l_returnflag glyph, j junction, count(*) n_segments, string_agg(s::varchar, ',' order by s::varchar) segments from (select l_returnflag, l_partkey j, l_orderkey*8+l_linenumber s from lineitem union all select l_returnflag, 10000000+l_suppkey, l_orderkey*8+l_linenumber from lineitem where l_suppkey%2=0) group by 1,2")
def segment_index(t: Tables) -> DataFrame:
    """Of each junction of each glyph the segments that touch it; here order lines between parts and half of the suppliers."""
    to = F.when(c("l_suppkey") % 2 == 0, 10000000 + c("l_suppkey")).otherwise(-1)
    s = t.lineitem.select(c("l_returnflag").alias("glyph"), (c("l_orderkey") * 8 + c("l_linenumber")).alias("segment"), c("l_partkey").cast("bigint").alias("start"), to.cast("bigint").alias("end"))
    return G.junction_index(s).select("glyph", "junction", F.size("segments").cast("bigint").alias("n_segments"), F.array_join(F.array_sort(F.transform("segments", lambda v: v.cast("string"))), ",").alias("segments"))


@query("select source, doc_id//1000 block, count(*) n, string_agg(doc_id::varchar, ',' order by doc_id) items from documents group by 1,2")
def writer_index(t: Tables) -> DataFrame:
    """The documents of each source, in blocks of neighbouring ids."""
    return G.inverted_index(t.documents, "source", "doc_id").select("source", "block", F.size("items").cast("bigint").alias("n"), F.array_join("items", ",").alias("items"))


@query()
def search_frames(t: Tables) -> DataFrame:
    """For each mask the frames of a search that fits a stroke to it, by ticks; the stream stops after two ticks and goes on from its checkpoint."""
    from ..streaming import search as Q
    from .glyph_queries import big_masks

    folder, schema = scratch(t.spark, "search"), "glyph long, tick long, mask binary, width int"
    for ticks in ((0, 1), (2, 3, 4)):
        rows = big_masks(t).select(c("vec_id").cast("long").alias("glyph"), F.explode(F.array(*[F.lit(k).cast("long") for k in ticks])).alias("tick"), "mask", "width")
        rows.write.mode("append").parquet(f"{folder}/ticks")
        stream = t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{folder}/ticks")
        Q.run_search(stream, f"{folder}/frames", f"{folder}/checkpoint")
    found = t.spark.read.parquet(f"{folder}/frames")
    return found.select(c("glyph").alias("vec_id"), "tick", "phase", "rounds", F.round("score", 6).alias("score"), F.round("best", 6).alias("best"), "done")


# ---- statistics, texts, points ----


@query(" union all ".join(f"select '{n}' name, count(*) n from {n}" for n in NAMES))
def all_table_counts(t: Tables) -> DataFrame:
    """The rows of all tables; Spark reads nothing but their footers."""
    out = None
    for n in NAMES:
        one = getattr(t, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


_MEANS = {"price": "o_totalprice", "placed": "year(o_orderdate)", "key": "o_orderkey", "customer": "o_custkey", "urgent": "case when o_orderpriority='1-URGENT' then 1 else 0 end"}


@query("select 'mean' kind, name, value, null::bigint o_orderkey from (unpivot (select " + ", ".join(f"round(coalesce(avg({e}) filter (o_orderstatus<>'P'),0),4)::double {n}" for n, e in _MEANS.items()) + " from orders) on columns(*) into name name value value) union all select 'failed', o_orderstatus, null, o_orderkey from orders where o_orderstatus='P'")
def suite_summary(t: Tables) -> DataFrame:
    """Five means over the rows that are well, and a row for each that failed."""
    ok = t.orders.where("o_orderstatus != 'P'")
    means = ok.agg(*[F.round(F.coalesce(F.avg(F.expr(e)), F.lit(0)), 4).cast("double").alias(n) for n, e in _MEANS.items()])
    rows = means.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c(n).alias("value")) for n in _MEANS])).alias("m")).select(F.lit("mean").alias("kind"), "m.name", "m.value", F.lit(None).cast("bigint").alias("o_orderkey"))
    failed = t.orders.where("o_orderstatus = 'P'").select(F.lit("failed"), "o_orderstatus", F.lit(None).cast("double"), c("o_orderkey").cast("bigint"))
    return rows.union(failed)


@query(
    "with d as (select source, lang, text, length(coalesce(text,'')) n from documents), per as (select source, lang, count(*) k from d group by 1,2), w as (select source, count(distinct lang) langs, sum(k)/count(*) each from per group by 1), "
    "words as (select source, unnest(list_filter(string_split_regex(coalesce(text,''), '[\\x20\\x09-\\x0D]+'), lambda x: x<>'')) word from d) "
    "select round(avg(langs),6) chars_per_writer, round(avg(each),6) samples_per_char, (select round(avg(n),4) from d) avg_length, (select min(n) from d) min_length, (select max(n) from d) max_length, (select count(distinct word) from words) vocabulary, (select count(*) from d where n<100) skipped from w"
)
def writer_stats(t: Tables) -> DataFrame:
    """Languages of a source, texts of a language and source, lengths of texts, distinct words, and how many texts are short."""
    d = t.documents.select("source", "lang", F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.length("text"))
    writers = d.groupBy("source", "lang").agg(F.count("*").alias("k")).groupBy("source").agg(F.count_distinct("lang").alias("langs"), (F.sum("k") / F.count("*")).alias("each"))
    one = writers.agg(F.round(F.avg("langs"), 6).alias("chars_per_writer"), F.round(F.avg("each"), 6).alias("samples_per_char"))
    lengths = d.agg(F.round(F.avg("n"), 4).alias("avg_length"), F.min("n").alias("min_length"), F.max("n").alias("max_length"), F.sum(F.when(c("n") < 100, 1).otherwise(0)).alias("skipped"))
    words = d.select(F.explode(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).alias("word")).agg(F.count_distinct("word").alias("vocabulary"))
    return one.join(lengths, F.lit(True)).join(words, F.lit(True))  # one row each


@query(f"select conv_id, turn, round(case when turn%3=0 or length(b)=0 then 0.0 else greatest(0.0, 1-levenshtein(a,b)/greatest(length(a),length(b))::double) end,6) confidence from ({TURNS})")
def error_confidence(t: Tables) -> DataFrame:
    """A reading that reports an error counts nothing; every third turn's does."""
    said = F.when(c("turn") % 3 == 0, F.concat(F.lit("ERROR: "), "b")).otherwise(c("b"))
    return _turns(t).select("conv_id", "turn", F.round(X.edit_confidence(c("a"), said, errors=True), 6).alias("confidence"))


@query(
    f"with p as (select *, [i*0.5 for i in range(0,32)] ts, list_prepend(0.0::double, [sqrt((xs[i]-xs[i-1])**2+(ys[i]-ys[i-1])**2) for i in range(2,len(xs)+1)]) seg from ({POINTS})), q as (select *, [list_sum(seg[1:i]) for i in range(1,len(seg)+1)] cum from p), "
    "r as (select vec_id, k, xs, ts, cum, cum[len(cum)]*k/11.0 target, least(len(xs)-1, greatest(1, len(list_filter(cum, lambda m: m<=cum[len(cum)]*k/11.0)))) i from q cross join range(0,12) r(k)) "
    "select vec_id, count(*)::int n, round(sum(xs[i]+(xs[i+1]-xs[i])*w),4) sx, round(sum(ts[i]+(ts[i+1]-ts[i])*w),4) st from (select *, case when cum[i+1]=cum[i] then 0.0 else (target-cum[i])/(cum[i+1]-cum[i]) end w from r) group by vec_id"
)
def resampled_in_time(t: Tables) -> DataFrame:
    """Strokes at equal arc lengths, each point with its time."""
    timed = F.transform(P.from_pairs(c("embedding")), lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), (i * 0.5).cast("double").alias("t")))
    q = t.embeddings.select("vec_id", P.resampled(timed, 12, ("t",)).alias("q"))
    return q.select("vec_id", F.size("q").alias("n"), F.round(P.total(F.transform("q", lambda v: v["x"])), 4).alias("sx"), F.round(P.total(F.transform("q", lambda v: v["t"])), 4).alias("st"))
