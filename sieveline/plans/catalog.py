"""Registered queries: each operator applied to the driver's tables, with the SQL that must give the same rows.

A stand-in for each relation: documents for assets, labels for checks, orders for jobs and
removals, lineitem for staged rows, events for histories, embeddings for point arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import points as P
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import changes as D
from ..operators import ranking as R
from ..operators import relational as J
from ..operators import similarity as S
from ..operators import spatial as G
from ..session import ship
from ..sources import files as FS
from ..sources import pages as H
from ..streaming import progress as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of a folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        ship(spark)

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


c = F.col

# ---- joins, filters ----


@query("select p.p_partkey, p.p_brand, avg(l.l_quantity) avg_quality, count(l.l_linenumber) char_count from part p join lineitem l on p.p_partkey=l.l_partkey join supplier s on s.s_suppkey=l.l_suppkey where l.l_returnflag='N' and s.s_acctbal>0 group by p.p_partkey, p.p_brand order by avg_quality desc, p.p_partkey limit 10")
def best_groups(t: Tables) -> DataFrame:
    """Three-way join, mean and count for each group, the ten best."""
    lines = t.lineitem.where("l_returnflag = 'N'").join(t.supplier.where("s_acctbal > 0").select("s_suppkey"), c("l_suppkey") == c("s_suppkey"))
    return t.part.join(lines, c("p_partkey") == c("l_partkey")).groupBy("p_partkey", "p_brand").agg(F.avg("l_quantity").alias("avg_quality"), F.count("l_linenumber").alias("char_count")).orderBy(F.desc("avg_quality"), "p_partkey").limit(10)


@query("select doc_id, lang, source from documents where doc_id = 7")
def key_lookup(t: Tables) -> DataFrame:
    """P1"""
    return J.by_key(t.documents, doc_id=7).select("doc_id", "lang", "source")


@query("select conv_id, turn, role from conversations where conv_id = 3 and turn = 1")
def composite_lookup(t: Tables) -> DataFrame:
    """P2"""
    return J.by_key(t.conversations, conv_id=3, turn=1).select("conv_id", "turn", "role")


@query("select event_id, event_type from events where value is not null order by event_type, event_id")
def with_value(t: Tables) -> DataFrame:
    """P3 O1"""
    return J.with_value(t.events, "value", "event_type", "event_id").select("event_id", "event_type")


@query("select d.doc_id from documents d left join labels l on d.doc_id=l.doc_id where l.quality is null")
def needs_check(t: Tables) -> DataFrame:
    """J1 P5"""
    return J.needing(t.documents, t.labels, "doc_id", "quality").select("doc_id")


@query("select d.doc_id, d.source from documents d join labels l on d.doc_id=l.doc_id where l.toxic=0 and l.quality=1")
def ready_items(t: Tables) -> DataFrame:
    """J2 P6 P18"""
    return J.passing(t.documents, t.labels, "doc_id", (c("toxic") == 0) & (c("quality") == 1)).select("doc_id", "source")


@query("select d.doc_id from documents d left join labels l on d.doc_id=l.doc_id left join (select doc_id from labels where toxic=1) r on d.doc_id=r.doc_id where r.doc_id is null and (l.quality=1 or l.quality is null)")
def eligible_tolerant(t: Tables) -> DataFrame:
    """J4 J5 P7"""
    return J.eligible(t.documents, t.labels, t.labels.where("toxic = 1"), "doc_id", c("quality") == 1).select("doc_id")


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderstatus='P')")
def active_not_in(t: Tables) -> DataFrame:
    """J6 J7"""
    return J.not_in(t.customer, t.orders.where("o_orderstatus = 'P'"), "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("select (select count(*) from customer where c_custkey not in (select case when o_orderkey=1 then null else o_custkey end from orders)) n")
def not_in_with_null(t: Tables) -> DataFrame:
    """J6 with a null on the right: nothing is left."""
    right = t.orders.select(F.when(c("o_orderkey") != 1, c("o_custkey")).alias("k"))
    return J.not_in(t.customer, right, "c_custkey", "k").agg(F.count("*").alias("n"))


@query("select c.c_custkey, (select count(*) from orders o2 where o2.o_custkey=c.c_custkey) as char_count from customer c join orders o on o.o_custkey=c.c_custkey where o.o_orderstatus='F'")
def rejected_fanout(t: Tables) -> DataFrame:
    """A row for each removal, with the scalar count."""
    hit = J.rejected(t.customer.select("c_custkey"), t.orders.where("o_orderstatus = 'F'"), "c_custkey", "o_custkey")
    return J.counted(hit, t.orders, "c_custkey", "o_custkey", "char_count")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderstatus='F')")
def rejected_distinct(t: Tables) -> DataFrame:
    return J.rejected(t.customer, t.orders.where("o_orderstatus = 'F'"), "c_custkey", "o_custkey", distinct=True).select("c_custkey")


@query("select c.c_custkey, coalesce(cs.n,0) as char_count from customer c left join (select o_custkey, count(*) n from orders where o_totalprice is not null group by o_custkey) cs on cs.o_custkey=c.c_custkey")
def list_with_counts(t: Tables) -> DataFrame:
    """J8"""
    return J.counted(t.customer.select("c_custkey"), t.orders.where("o_totalprice is not null"), "c_custkey", "o_custkey", "char_count")


@query("select c.c_custkey from customer c left join (select o_custkey, count(*) n from orders group by o_custkey) s on s.o_custkey=c.c_custkey where coalesce(s.n,0) < 10")
def unfinished_items(t: Tables) -> DataFrame:
    """P24"""
    return J.counted(t.customer.select("c_custkey"), t.orders, "c_custkey", "o_custkey", "n").where("n < 10").select("c_custkey")


@query("select r.r_name code, count(n.n_nationkey) cnt from region r left join nation n on n.n_regionkey=r.r_regionkey group by r.r_name order by cnt desc, code")
def removal_stats(t: Tables) -> DataFrame:
    """J11 A40"""
    return J.lookup_counts(t.region, t.nation, "r_regionkey", "n_regionkey", "r_name")


@query("select o.o_orderkey, c.c_name, n.n_name reason_code from orders o join customer c on o.o_custkey=c.c_custkey join nation n on c.c_nationkey=n.n_nationkey where n.n_name='NATION_3'")
def removed_history(t: Tables) -> DataFrame:
    """J10"""
    return J.history(t.orders, t.customer, t.nation, [("o_custkey", "c_custkey"), ("c_nationkey", "n_nationkey")], c("n_name") == "NATION_3").select("o_orderkey", "c_name", c("n_name").alias("reason_code"))


@query("select event_id from events where event_type = (select event_type from events where event_id = 5)")
def same_as_parent(t: Tables) -> DataFrame:
    """J12"""
    return J.by_parent(t.events, t.events.select(c("event_id").alias("pid"), c("event_type").alias("ptype")), "event_type", c("pid") == 5, "ptype").select("event_id")


@query("select o.o_orderkey from orders o left join (select c_custkey from customer where c_acctbal<0) e on o.o_custkey=e.c_custkey where e.c_custkey is null")
def staging_anti(t: Tables) -> DataFrame:
    """J13 U2"""
    return J.staged_anti(t.orders, [t.customer.where("c_acctbal < 0").select("c_custkey")], "o_custkey").select("o_orderkey")


@query("select o.o_orderkey from orders o where o.o_custkey not in (select c_custkey from customer where c_acctbal<0 union select s_suppkey from supplier)")
def staging_anti_union(t: Tables) -> DataFrame:
    """Against the union of two key sets."""
    return J.staged_anti(t.orders, [t.customer.where("c_acctbal < 0").select("c_custkey"), t.supplier.select(c("s_suppkey").alias("c_custkey"))], "o_custkey").select("o_orderkey")


@query("select c.c_custkey, r.r_regionkey from customer c cross join region r")
def cross_charset(t: Tables) -> DataFrame:
    """J17"""
    return J.product(t.customer.select("c_custkey"), t.region.select("r_regionkey"))


@query("select c.c_custkey, r.r_name from customer c join region r on c.c_custkey % 5 = r.r_regionkey")
def round_robin_base(t: Tables) -> DataFrame:
    """J19"""
    return J.round_robin(t.customer.select("c_custkey"), "c_custkey", t.region.select(c("r_regionkey").cast("int").alias("slot"), "r_name")).select("c_custkey", "r_name")


@query("select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey=c.c_custkey and o.o_totalprice>100000)")
def semi_exists(t: Tables) -> DataFrame:
    """J29 P4"""
    return t.customer.join(t.orders.where("o_totalprice > 100000"), c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey")


@query("select l_orderkey, l_linenumber, p_name from lineitem join part on l_partkey=p_partkey where l_returnflag in ('A','R') order by l_orderkey, l_linenumber, l_partkey limit 10")
def in_list_sample(t: Tables) -> DataFrame:
    """J30 P9"""
    return J.active_in(t.lineitem, "l_returnflag", ["A", "R"]).join(t.part, c("l_partkey") == c("p_partkey")).orderBy("l_orderkey", "l_linenumber", "l_partkey").limit(10).select("l_orderkey", "l_linenumber", "p_name")


@query("select max(o_orderkey) o_orderkey from orders where o_orderstatus in ('O','P')")
def newest_active(t: Tables) -> DataFrame:
    """P10"""
    return J.active_in(t.orders, "o_orderstatus", ["O", "P"], newest="o_orderkey").select("o_orderkey")


@query("select o_orderkey id from orders where o_custkey = 10 and o_orderstatus = 'O' order by o_orderkey limit 20")
def pending_page(t: Tables) -> DataFrame:
    """P8 O4 O5"""
    rows = t.orders.select(c("o_orderkey").alias("id"), c("o_custkey").alias("job_id"), F.when(c("o_orderstatus") == "O", "pending").otherwise("done").alias("status"))
    return J.pending(rows, 10, limit=J.clamp_limit("20")).select("id")


@query("select p_partkey from part where lower(p_name) like '%small%' or lower(p_name) like '%ring%'")
def keyword_match(t: Tables) -> DataFrame:
    """P14"""
    return t.part.where(X.any_keyword(c("p_name"), ("small", "ring"))).select("p_partkey")


@query("select p_partkey from part where p_name not like 'part\\_1%' escape '\\'")
def like_filter(t: Tables) -> DataFrame:
    """P13"""
    return t.part.where(~c("p_name").like("part\\_1%")).select("p_partkey")


@query("select o_orderkey, (case when o_totalprice<10000 then 1 else 0 end)+(case when o_totalprice>200000 then 1 else 0 end)+(case when o_orderpriority='5-LOW' then 1 else 0 end) as n_issues from orders")
def issue_counts(t: Tables) -> DataFrame:
    """P16"""
    rules = F.array_compact(F.array(F.when(c("o_totalprice") < 10000, 1), F.when(c("o_totalprice") > 200000, 1), F.when(c("o_orderpriority") == "5-LOW", 1)))
    return t.orders.select("o_orderkey", F.size(rules).alias("n_issues"))


@query("select o_orderkey, 'cheap' reason from orders where o_totalprice<10000 union all select o_orderkey, 'low' from orders where o_orderpriority='5-LOW'")
def failing_rules(t: Tables) -> DataFrame:
    """P15 D29"""
    return A.failing_rules(t.orders, "o_orderkey", {"cheap": c("o_totalprice") < 10000, "low": c("o_orderpriority") == "5-LOW"})


@query("select p_partkey, case when p_size%17<10 or p_size%17>15 then 1 else 0 end + case when p_retailprice>1000 then 1 else 0 end + case when p_size%3=0 then 1 else 0 end + case when p_size%4<>2 then 1 else 0 end n from part")
def quality_issues(t: Tables) -> DataFrame:
    """The labels of the rules an item breaks."""
    labels = A.quality_issues(c("p_size") % 17, c("p_retailprice") / 1000, c("p_size") % 3 == 0, c("p_size") % 4, F.array().cast("array<string>"), most=1.0)
    return t.part.select("p_partkey", F.size(labels).cast("bigint").alias("n"))


# ---- aggregates ----


@query("select count(*) total, sum(case when quality=1 then 1 else 0 end) complete, sum(case when toxic=1 then 1 else 0 end) rejected, sum(case when quality=1 and toxic=0 then 1 else 0 end) passing from labels")
def funnel_stats(t: Tables) -> DataFrame:
    """A1 A14"""
    return A.funnel(t.labels, complete=c("quality") == 1, rejected=c("toxic") == 1, passing=(c("quality") == 1) & (c("toxic") == 0))


@query("select count(distinct o_custkey) with_facts, (select count(*) from customer) - count(distinct o_custkey) as without_facts from orders")
def distinct_counts(t: Tables) -> DataFrame:
    """A2 A3"""
    return A.with_and_without(t.customer, t.orders, "o_custkey")


@query("select o.o_orderkey, count(*) filter (l_returnflag='A') downloaded, count(*) filter (l_returnflag='R') failed, count(*) filter (l_returnflag='N') pending from orders o left join lineitem l on l.l_orderkey=o.o_orderkey group by o.o_orderkey")
def status_pivot(t: Tables) -> DataFrame:
    """A5 A6 A7"""
    return A.status_pivot(t.orders.select("o_orderkey"), t.lineitem, "o_orderkey", "l_orderkey", "l_returnflag", {"downloaded": "A", "failed": "R", "pending": "N"})


@query("select case when regexp_matches(text, '^[A-Za-z]') then upper(substr(text,1,1)) else '#' end letter, count(*) cnt from documents group by 1")
def letter_counts(t: Tables) -> DataFrame:
    """A8 P11 P12"""
    return A.letter_counts(t.documents, "text")


@query("select distinct lang from documents where lang is not null order by lang")
def distinct_category(t: Tables) -> DataFrame:
    """A9"""
    return t.documents.where("lang is not null").select("lang").distinct().orderBy("lang")


@query("select avg(n_chars) avg_p, min(n_chars) min_p, max(n_chars) max_p from documents")
def point_stats(t: Tables) -> DataFrame:
    """A10"""
    return t.documents.agg(F.avg("n_chars").alias("avg_p"), F.min("n_chars").alias("min_p"), F.max("n_chars").alias("max_p"))


@query("select 'documents' name, count(*) n from documents union all select 'labels', count(*) from labels union all select 'orders', count(*) from orders")
def table_counts(t: Tables) -> DataFrame:
    """A11"""
    each = [getattr(t, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("documents", "labels", "orders")]
    return each[0].union(each[1]).union(each[2])


@query("select user_id, round(sum(case when event_type<>'error' then value else 0 end)/greatest(sum(case when event_type<>'error' then 1 else 0 end),1),4) avg_value, sum(case when event_type<>'error' then 1 else 0 end) ok, count(*) tested from events group by user_id")
def ok_means(t: Tables) -> DataFrame:
    """A12 A13"""
    return A.conditional_means(t.events, ["user_id"], c("event_type") != "error", ["value"]).withColumn("avg_value", F.round("avg_value", 4))


@query("select avg(n) avg_types from (select user_id, count(distinct event_type) n from events group by user_id) t")
def two_level_stats(t: Tables) -> DataFrame:
    """A15 A19"""
    return t.events.groupBy("user_id").agg(F.count_distinct("event_type").alias("n")).agg(F.avg("n").alias("avg_types"))


@query("select md5(text) h, min(doc_id) first_id, count(*) n from documents group by 1 having count(*)>1")
def exact_groups(t: Tables) -> DataFrame:
    """Equal hashes."""
    return t.documents.groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


@query("select source, count(*) n from documents group by source")
def source_totals(t: Tables) -> DataFrame:
    """A39"""
    return t.documents.groupBy("source").agg(F.count("*").alias("n"))


@query("select l_orderkey, l_linenumber, l_partkey, round(0.35*(l_discount*10)+0.15*(1-l_tax*10)+0.2*(l_quantity/50)+0.3*(l_discount),6) score from lineitem")
def stroke_score(t: Tables) -> DataFrame:
    """A22 (A20 A21 A23 A24 use the same function)."""
    m = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (c("l_discount") * 10).alias("coverage"), (c("l_tax") * 10).alias("overshoot"), (c("l_quantity") / 50).alias("stroke_count"), c("l_discount").alias("topology"))
    return m.select("l_orderkey", "l_linenumber", "l_partkey", F.round(A.weighted(A.STROKE_SCORE, ["overshoot"]), 6).alias("score"))


@query("select o_orderkey, round(0.6*(o_totalprice/500000)+0.4*(o_custkey%10/10.0),3) score from orders")
def asset_score(t: Tables) -> DataFrame:
    """A21"""
    return t.orders.select("o_orderkey", (c("o_totalprice") / 500000).alias("coverage"), (c("o_custkey") % 10 / 10.0).alias("style")).select("o_orderkey", F.round(A.weighted(A.ASSET_SCORE), 3).alias("score"))


@query("select user_id, round(case when v<0.02 then v/0.02*0.5 when v<0.1 then 0.5+(v-0.02)/0.08*0.5 else greatest(0.3, 1.0-(v-0.1)*2) end,4) baseline, round(case when cv<0.05 then cv/0.05*0.3 when cv<0.25 then 0.3+(cv-0.05)/0.2*0.7 else greatest(0.4,1.0-(cv-0.25)*2) end,4) width from (select user_id, stddev_pop(value)/1000 v, stddev_pop(value)/(avg(value)+1e-6) cv from events group by user_id)")
def variation_scores(t: Tables) -> DataFrame:
    """A25 A26"""
    g = t.events.groupBy("user_id").agg((F.stddev_pop("value") / 1000).alias("v"), A.variation_coefficient("value").alias("cv"))
    return g.select("user_id", F.round(A.baseline_score(c("v")), 4).alias("baseline"), F.round(A.width_score(c("cv")), 4).alias("width"))


@query("select round(stddev_pop(a),4) slant from (select user_id, degrees(atan(regr_slope(value, event_id))) a from events group by user_id having count(*)>2)")
def slant_spread(t: Tables) -> DataFrame:
    """A27"""
    g = t.events.groupBy("user_id").agg(F.degrees(F.atan(F.regr_slope("value", "event_id"))).alias("a"), F.count("*").alias("n")).where("n > 2")
    return g.agg(F.round(F.stddev_pop("a"), 4).alias("slant"))


@query("select round(quantile_cont(l_quantity, 0.9),6) p from lineitem")
def adaptive_radius(t: Tables) -> DataFrame:
    """A28"""
    return A.adaptive_percentile(t.lineitem, "l_quantity", 0.9).select(F.round("p", 6).alias("p"))


@query("select count(distinct l_partkey)/(select count(*) from part)::double coverage from lineitem where l_returnflag='R'")
def set_coverage(t: Tables) -> DataFrame:
    """A29"""
    return A.coverage(t.lineitem.where("l_returnflag = 'R'"), t.part.count(), "l_partkey")


@query("with h as (select distinct l_suppkey s, l_partkey p from lineitem where l_returnflag='R'), o as (select p, count(*) n from h group by p) select round(avg(e),6) overlap from (select s, greatest(0.0, count(*) filter (n>1)/count(*) - 0.25) e from h join o using (p) group by s)")
def overlap_excess(t: Tables) -> DataFrame:
    """A30 U5"""
    hits = t.lineitem.where("l_returnflag = 'R'").select(c("l_suppkey").alias("shape"), c("l_partkey").alias("cloud_id"))
    return A.overlap_excess(hits).select(F.round("overlap", 6).alias("overlap"))


@query("select l_suppkey, avg(case when l_discount<0.05 then 1.0 else 0.0 end) share from lineitem group by l_suppkey")
def share_of_rows(t: Tables) -> DataFrame:
    """A31"""
    return t.lineitem.groupBy("l_suppkey").agg(F.avg((c("l_discount") < 0.05).cast("double")).alias("share"))


@query("select user_id, min(event_id) x_min, max(event_id) x_max, min(value) y_min, max(value) y_max, (min(event_id)+max(event_id))/2.0 cx from events group by user_id")
def bounding_box(t: Tables) -> DataFrame:
    """A32 A33"""
    return t.events.groupBy("user_id").agg(F.min("event_id").alias("x_min"), F.max("event_id").alias("x_max"), F.min("value").alias("y_min"), F.max("value").alias("y_max")).withColumn("cx", (c("x_min") + c("x_max")) / 2.0)


@query("select vec_id, case when u=0 then 0.0 else i/cast(u as double) end iou from (select vec_id, len(list_filter(range(1,64), lambda k: embedding[k]>0 and embedding[k+1]>0)) i, len(list_filter(range(1,64), lambda k: embedding[k]>0 or embedding[k+1]>0)) u from embeddings)")
def array_iou(t: Tables) -> DataFrame:
    """A36"""
    n = F.size("embedding") - 1
    a, b = F.transform(F.slice("embedding", F.lit(1), n), lambda v: v > 0), F.transform(F.slice("embedding", F.lit(2), n), lambda v: v > 0)
    return t.embeddings.select("vec_id", A.iou(a, b).alias("iou"))


@query("select epoch, round(loss,4) loss from (select cast(floor(event_id/1000) as bigint) epoch, avg(value) loss from events group by 1)")
def epoch_means(t: Tables) -> DataFrame:
    """A37"""
    return t.events.groupBy(F.floor(c("event_id") / 1000).alias("epoch")).agg(F.round(F.avg("value"), 4).alias("loss"))


@query("select arg_min(epoch, loss) best from (select cast(floor(event_id/1000) as bigint) epoch, avg(value) loss from events group by 1)")
def best_epoch(t: Tables) -> DataFrame:
    """A38"""
    return t.events.groupBy(F.floor(c("event_id") / 1000).alias("epoch")).agg(F.avg("value").alias("loss")).agg(F.min_by("epoch", "loss").alias("best"))


@query("select user_id, 1 - len(list_filter(['view','signup','error','click','purchase'], lambda x: not list_contains(have, x)))/5.0 completeness, list_filter(['view','signup','error','click','purchase'], lambda x: not list_contains(have, x))::varchar missing from (select user_id, list(distinct event_type) have from events group by user_id)")
def completeness(t: Tables) -> DataFrame:
    """A41 P19 P20"""
    g = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("have"))
    share, missing = A.required_share(["view", "signup", "error", "click", "purchase"], c("have"))
    return g.select("user_id", share.alias("completeness"), F.concat(F.lit("["), F.array_join(missing, ", "), F.lit("]")).alias("missing"))


# ---- windows ----


@query("select doc_id, rn, first_value(doc_id) over (partition by source order by n_chars desc, doc_id) as keeper from (select doc_id, source, n_chars, row_number() over (partition by source order by n_chars desc, doc_id) rn from documents) t")
def best_of_group(t: Tables) -> DataFrame:
    """A17 W1"""
    return R.best_of_group(t.documents.select("doc_id", "source", "n_chars"), "source", "doc_id", [F.desc("n_chars"), "doc_id"]).select("doc_id", "rn", "keeper")


@query("select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) t where rn<=2")
def latest_runs(t: Tables) -> DataFrame:
    """W2"""
    return R.latest(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 2).select("user_id", "event_id")


@query("select event_id, value - lag(value) over (partition by user_id order by ts, event_id) delta from events")
def prev_run(t: Tables) -> DataFrame:
    """W3"""
    return t.events.select("event_id", R.difference("value", "user_id", ["ts", "event_id"], first_zero=False).alias("delta"))


@query("select event_id from (select event_id, row_number() over (order by event_id desc) rn from events) t where rn<=500")
def keep_newest(t: Tables) -> DataFrame:
    """W4"""
    return D.keep_newest(t.events, "event_id", 500).select("event_id")


@query("select user_id, event_id best_event, value from (select user_id, event_id, value, row_number() over (partition by user_id order by value desc, event_id) rn from events where value is not null) t where rn=1")
def first_best(t: Tables) -> DataFrame:
    """W5 D7"""
    return R.first_best(t.events.select("user_id", "event_id", "value"), "user_id", "value", "event_id").select("user_id", c("event_id").alias("best_event"), "value")


@query("select event_id, value > coalesce(max(value) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), -1e300) as improved from events where value is not null")
def running_best_flag(t: Tables) -> DataFrame:
    """W5"""
    return t.events.where("value is not null").select("event_id", R.improves("value", "user_id", "event_id").alias("improved"))


@query("select event_id, value - coalesce(lag(value) over (partition by user_id order by event_id), value) d from events")
def first_diff(t: Tables) -> DataFrame:
    """W6"""
    return t.events.select("event_id", R.difference("value", "user_id", ["event_id"]).alias("d"))


@query("select l_orderkey, l_linenumber, l_partkey, sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows between unbounded preceding and current row) cum from lineitem")
def prefix_sum(t: Tables) -> DataFrame:
    """W7"""
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", R.prefix_sum("l_quantity", "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).alias("cum"))


@query("select event_id, round(avg(value) over (partition by user_id order by event_id rows between 1 preceding and 1 following),4) ma from events")
def moving_avg(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(R.moving_average("value", "user_id", ["event_id"]), 4).alias("ma"))


@query("select event_id, round((coalesce(lag(value) over w, value) + value + coalesce(lead(value) over w, value))/3,4) ma from events window w as (partition by user_id order by event_id)")
def padded_avg(t: Tables) -> DataFrame:
    """W9"""
    return t.events.select("event_id", F.round(R.padded_average("value", "user_id", ["event_id"]), 4).alias("ma"))


@query("select user_id, round(stddev_pop(d2),4) roughness from (select user_id, lead(value) over w - 2*value + lag(value) over w d2 from events window w as (partition by user_id order by event_id)) group by user_id")
def edge_roughness(t: Tables) -> DataFrame:
    """W11 W14"""
    return t.events.select("user_id", R.second_difference("value", "user_id", ["event_id"]).alias("d2")).groupBy("user_id").agg(F.round(F.stddev_pop("d2"), 4).alias("roughness"))


@query("select event_id from (select event_id, event_type, lag(event_type) over (partition by user_id order by event_id) p from events) where p is null or p<>event_type")
def changes_only(t: Tables) -> DataFrame:
    """W12"""
    return t.events.withColumn("_k", R.changed("event_type", "user_id", ["event_id"])).where("_k").select("event_id")


@query("select event_id from (select event_id, row_number() over (order by event_id) rn from events) t where rn % 500 = 0")
def progress_rows(t: Tables) -> DataFrame:
    """W16"""
    return R.every_kth(t.events, "event_id", 500).select("event_id")


@query("select event_id from (select event_id from events order by event_id desc limit 20) order by event_id")
def log_tail(t: Tables) -> DataFrame:
    """O6"""
    return R.tail(t.events, "event_id", 20).select("event_id")


@query("select c_custkey, c_acctbal from customer where c_acctbal is not null order by c_acctbal desc, c_custkey limit 10")
def top_k(t: Tables) -> DataFrame:
    """O2 O9"""
    return t.customer.where("c_acctbal is not null").orderBy(F.desc("c_acctbal"), "c_custkey").limit(10).select("c_custkey", "c_acctbal")


@query("select * from (select c_custkey, c_acctbal from customer order by c_acctbal, c_custkey limit 5) union all select * from (select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 5)")
def bottom_and_top(t: Tables) -> DataFrame:
    """O3 O8"""
    rows = t.customer.select("c_custkey", "c_acctbal")
    return rows.orderBy("c_acctbal", "c_custkey").limit(5).union(rows.orderBy(F.desc("c_acctbal"), "c_custkey").limit(5))


# ---- runs ----


@query("select coalesce(a.k,b.k) k, a.v old_score, b.v new_score, round(b.v-a.v,3) delta from (select o_custkey k, max(o_totalprice) v from orders where o_orderstatus='F' group by o_custkey) a full outer join (select o_custkey k, max(o_totalprice) v from orders where o_orderstatus='O' group by o_custkey) b on a.k=b.k")
def compare_runs(t: Tables) -> DataFrame:
    """J14 O7 U3"""
    side = lambda s: t.orders.where(c("o_orderstatus") == s).groupBy(c("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return R.by_delta(R.compare_runs(side("F"), side("O"), "k", "v"), "k")


@query("with a as (select o_custkey k, avg(o_totalprice) score, min(o_totalprice) overshoot from orders where o_orderstatus='F' group by 1), b as (select o_custkey k, avg(o_totalprice) score, min(o_totalprice) overshoot from orders where o_orderstatus='O' group by 1) select a.k, 'score_regression' metric, round(a.score,0) was, round(b.score,0) now from a join b on a.k=b.k where a.score-b.score>5000 union all select a.k, 'overshoot_regression', round(a.overshoot,0), round(b.overshoot,0) from a join b on a.k=b.k where b.overshoot-a.overshoot>5000")
def regressions(t: Tables) -> DataFrame:
    """J15"""
    side = lambda s: t.orders.where(c("o_orderstatus") == s).groupBy(c("o_custkey").alias("k")).agg(F.avg("o_totalprice").alias("score"), F.min("o_totalprice").alias("overshoot")).withColumn("status", F.lit("ok"))
    return R.regressions(side("F"), side("O"), "k", ["score", "overshoot"], 5000).select("k", "metric", F.round("was", 0).alias("was"), F.round("now", 0).alias("now"))


# ---- mutations ----


@query("select coalesce(n.doc_id,o.doc_id) doc_id, coalesce(n.quality,o.quality) quality, o.toxic from (select doc_id, case when doc_id%4=0 then 1-quality end quality from labels where doc_id%2=0) n full outer join labels o on n.doc_id=o.doc_id")
def upsert_coalesce(t: Tables) -> DataFrame:
    """D2 D3 D4"""
    new = t.labels.where("doc_id % 2 = 0").select("doc_id", F.when(c("doc_id") % 4 == 0, 1 - c("quality")).alias("quality"))
    return D.partial_upsert(t.labels, new, ["doc_id"])


@query("select doc_id, quality, case when doc_id%2=0 then null else toxic end toxic from labels")
def insert_or_replace(t: Tables) -> DataFrame:
    """D6"""
    return D.insert_or_replace(t.labels, t.labels.where("doc_id % 2 = 0").select("doc_id", "quality"), ["doc_id"])


@query("select r_regionkey id, r_name name from region union all select 4 + row_number() over (order by name), name from (select distinct n_name name from nation where n_nationkey<5)")
def insert_or_ignore(t: Tables) -> DataFrame:
    """D1 D20"""
    old = t.region.select(c("r_regionkey").cast("bigint").alias("id"), c("r_name").alias("name"))
    new = t.nation.where("n_nationkey < 5").select(c("n_name").alias("name")).union(t.region.select("r_name"))
    return D.insert_or_ignore(old, new, ["name"])


@query("select o_orderkey, case when o_orderstatus='P' then 'O' else o_orderstatus end o_orderstatus from orders")
def reset_stuck(t: Tables) -> DataFrame:
    """D19"""
    return D.update(t.orders.select("o_orderkey", "o_orderstatus"), c("o_orderstatus") == "P", {"o_orderstatus": "O"})


@query("select o_orderkey id, case when o_orderkey in (select o_orderkey from orders where o_orderstatus='P' order by o_orderkey limit 25) then 'downloading' when o_orderstatus='P' then 'pending' else 'done' end status from orders")
def claim_batch(t: Tables) -> DataFrame:
    """D18 O4"""
    staged = t.orders.select(c("o_orderkey").alias("id"), F.when(c("o_orderstatus") == "P", "pending").otherwise("done").alias("status"))
    return D.claim(staged, 25)[1]


@query("select o_orderkey id, o_custkey asset_id, 8 reason_id from orders where o_orderstatus<>'F'")
def unreject_all(t: Tables) -> DataFrame:
    """D11"""
    removals = t.orders.select(c("o_orderkey").alias("id"), c("o_custkey").alias("asset_id"), F.when(c("o_orderstatus") == "F", 2).otherwise(8).alias("reason_id"))
    return D.unreject(removals, 2)[0]


@query("select asset_id, reason_id from (select distinct o_custkey asset_id, 2 reason_id from orders where o_orderstatus='F' union all select distinct o_custkey, 2 from orders where o_orderstatus='P' and o_custkey not in (select o_custkey from orders where o_orderstatus='F'))")
def batch_reject(t: Tables) -> DataFrame:
    """D8 D9 D10"""
    old = t.orders.where("o_orderstatus = 'F'").select(c("o_custkey").alias("asset_id")).distinct().select(F.lit(0).cast("bigint").alias("id"), "asset_id", F.lit(2).cast("bigint").alias("reason_id"))
    reasons = t.region.limit(1).select(F.lit(2).alias("id"), F.lit("duplicate").alias("code"))
    new = t.orders.where("o_orderstatus = 'P'").select(c("o_custkey").alias("asset_id"))
    return D.reject(old, new, reasons, "duplicate").select("asset_id", c("reason_id").cast("int").alias("reason_id"))


# ---- text ----

# letters beyond ASCII as free upper-case ones: DuckDB's edit distance counts bytes
PLAIN = "translate(regexp_replace(lower({0}), '^\\s+|\\s+$', '', 'g'), 'ßäçèéêíñóöüàâîïôûáúœ', 'ABCDEFGHIJKLMNOPQRST')"
TURNS = f"select a.conv_id, a.turn, {PLAIN.format('a.text')} a, {PLAIN.format('b.text')} b from conversations a join conversations b on b.conv_id=a.conv_id and b.turn=a.turn+1"


def _turns(t: Tables) -> DataFrame:
    """Each turn of a conversation with the next, both whole."""
    after = t.conversations.select(c("conv_id").alias("of"), (c("turn") - 1).alias("before"), c("text").alias("b"))
    return t.conversations.join(after, (c("conv_id") == c("of")) & (c("turn") == c("before"))).select("conv_id", "turn", c("text").alias("a"), "b")


@query(f"select conv_id, turn, round(case when length(b)=0 then 0.0 else greatest(0.0, 1-levenshtein(a,b)/greatest(length(a),length(b))::double) end,6) confidence from ({TURNS})")
def edit_confidence(t: Tables) -> DataFrame:
    """F1 F2 F4"""
    return _turns(t).select("conv_id", "turn", F.round(X.edit_confidence(c("a"), c("b")), 6).alias("confidence"))


@query()
def matching_ratio(t: Tables) -> DataFrame:
    """F3"""
    return _turns(t).select("conv_id", "turn", F.round(X.matching_ratio("a", "b"), 6).alias("ratio"))


@query("select page_id, regexp_extract(url,'([^/]*)/*$',1) base, substr(md5(url || ':' || page_id),1,12) k, case when contains(lower(url),'/fr/') then 'fr' when contains(lower(url),'/de/') then 'de' else 'unknown' end src, coalesce(nullif(trim(regexp_replace(url,'[<>:\"/\\\\|?*]','_','g'),'. '),''),'unnamed') safe from pages where url is not null")
def names_and_paths(t: Tables) -> DataFrame:
    """F5 F6 F7 F8 F11"""
    u = c("url")
    return t.pages.where("url is not null").select("page_id", X.base_name(u).alias("base"), X.content_key(u, c("page_id").cast("string")).alias("k"), X.detect_source(u, ["fr", "de"]).alias("src"), X.safe_file_name(u).alias("safe"))


@query("select page_id, len(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*\"([^\"]*)\"[^>]*>(.*?)</a>')) n_links from pages")
def link_counts(t: Tables) -> DataFrame:
    """All links"""
    found = H.links(t.pages, "page_id", "html").groupBy(c("page_id").alias("_p")).agg(F.count("*").alias("n"))
    return t.pages.join(found, c("page_id") == c("_p"), "left").select("page_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"))


@query("with l as (select page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*\"([^\"]*)\"[^>]*>.*?</a>', 1)) href, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*\"[^\"]*\"[^>]*>(.*?)</a>', 1)) name from pages) select distinct page_id, 'http://x.example' || href url from l where length(name)>=2 and lower(name) not in ('download','preview','share','embed')")
def search_page(t: Tables) -> DataFrame:
    """S21 S22"""
    return H.search_page(t.pages, "page_id", "html", "http://x.example", "/").select("page_id", "url")


@query("select event_id, cast(json_extract(props,'$.k') as bigint) k from events")
def json_field(t: Tables) -> DataFrame:
    """F46"""
    return t.events.select("event_id", H.guarded_json(F.concat(F.lit(")]}'"), c("props")), "k bigint")["k"].alias("k"))


@query("select event_id, 'data: {\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' || chr(10) || chr(10) frame from events")
def event_frames(t: Tables) -> DataFrame:
    """S26"""
    return t.events.select("event_id", X.event_frame("event_id", "event_type").alias("frame"))


@query("select l_orderkey, l_linenumber, l_partkey, printf('%.1f%%', l_quantity*100) pct, round(l_discount,1) r from lineitem")
def percent_format(t: Tables) -> DataFrame:
    """F16 F49"""
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", X.percent(c("l_quantity")).alias("pct"), F.round("l_discount", 1).alias("r"))


@query("select p_partkey, case when n=0 then 0.0 when n<=3 then 1-(n-1)/9.0 when n<9 then (9-n)/9.0 else 0.0 end connectivity from (select p_partkey, p_size%12 n from part)")
def connectivity(t: Tables) -> DataFrame:
    """F50 P17"""
    return t.part.select("p_partkey", A.connectivity_score(c("p_size") % 12, A.expected_components(F.lit("minimum"))).alias("connectivity"))


@query("select p_partkey, case when r>0.1 and r<0.3 then 0.8 when r>0.05 and r<0.5 then 0.5 else 0.2 end ink, case when h=0 then 0.5 when w/h between 0.3 and 2.0 then 1.0 when w/h between 0.1 and 3.0 then 0.7 else 0.3 end aspect, case when s=0 then 0.0 else (case when s>10 then greatest(0.0,1-(s-10)/20.0) else 1.0 end + least(1.0, s*3/20.0))/2 end complete from (select p_partkey, p_size/50.0 r, (p_size%7)::double w, (p_size%5)::double h, p_size%15 s from part)")
def step_scores(t: Tables) -> DataFrame:
    """F52 F53"""
    s = c("p_size") % 15
    return t.part.select("p_partkey", A.ink_step(c("p_size") / 50.0, (0.1, 0.3), (0.05, 0.5)).alias("ink"), A.aspect_score((c("p_size") % 7).cast("double"), (c("p_size") % 5).cast("double")).alias("aspect"), A.completeness_score(s, s * 3).alias("complete"))


@query("select vec_id, list_aggregate(p,'sum') total, list_aggregate(p,'max') top from (select vec_id, [round(exp(x-m)/list_aggregate([exp(y-m) for y in e],'sum'),6) for x in e] p from (select vec_id, embedding::double[] e, list_max(embedding)::double m from embeddings))")
def softmax(t: Tables) -> DataFrame:
    """F55"""
    p = F.transform(X.softmax(c("embedding").cast("array<double>")), lambda v: F.round(v, 6))
    both = X.once(p, lambda p: F.struct(F.aggregate(p, F.lit(0.0), lambda s, v: s + v).alias("total"), F.array_max(p).alias("top")))
    return t.embeddings.select("vec_id", both.alias("s")).select("vec_id", "s.*")


# ---- points ----

POINTS = "select vec_id, [embedding[2*i-1]::double for i in range(1, len(embedding)//2+1)] xs, [embedding[2*i]::double for i in range(1, len(embedding)//2+1)] ys from embeddings"


def _points(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", P.from_pairs(c("embedding")).alias("p"))


@query(f"select vec_id, round(list_sum([sqrt((xs[i]-xs[i-1])**2+(ys[i]-ys[i-1])**2) for i in range(2,len(xs)+1)]),4) length, round(list_min(xs),5) x_min, round(list_max(ys),5) y_max, round(list_avg(xs),5) cx from ({POINTS})")
def path_measures(t: Tables) -> DataFrame:
    """F17 F22 F23 A32 A33"""
    p = c("p")
    return _points(t).select("vec_id", F.round(P.path_length(p), 4).alias("length"), F.round(P.box(p)["x_min"], 5).alias("x_min"), F.round(P.box(p)["y_max"], 5).alias("y_max"), F.round(P.centroid(p)["x"], 5).alias("cx"))


@query(f"select vec_id, round(list_sum([xs[i]-xs[i-1] for i in range(2,len(xs)+1)]),4) dx, round(list_sum([ys[i]-ys[i-1] for i in range(2,len(ys)+1)]),4) dy from ({POINTS})")
def relative_points(t: Tables) -> DataFrame:
    """Differences, then their running sum ends where the path does."""
    ends = _points(t).select("vec_id", F.element_at(P.running(P.steps(c("p"))), -1).alias("e"))
    return ends.select("vec_id", F.round("e.x", 4).alias("dx"), F.round("e.y", 4).alias("dy"))


@query(f"select vec_id, round(list_sum([(x-cx)*2*cos(0.3)-(y-cy)*0.5*sin(0.3)+cx+1 for (x,y) in list_zip(xs,ys)]),3) sx from (select *, list_avg(xs) cx, list_avg(ys) cy from ({POINTS}))".replace("for (x,y) in list_zip(xs,ys)", "for i in range(1,len(xs)+1)").replace("(x-cx)", "(xs[i]-cx)").replace("(y-cy)", "(ys[i]-cy)"))
def affine(t: Tables) -> DataFrame:
    """F38"""
    return _points(t).select("vec_id", F.round(P.total(F.transform(P.affine(c("p"), tx=1, sx=2, sy=0.5, theta=0.3), lambda q: q["x"])), 3).alias("sx"))


@query(f"select vec_id, round(h*k,4) height, round(list_max([abs(x-cx)*k for x in xs]),4) reach from (select *, case when h=0 then 1.0 else 100/h end k from (select *, list_max(ys)-list_min(ys) h, (list_max(xs)+list_min(xs))/2 cx from ({POINTS})))")
def to_height(t: Tables) -> DataFrame:
    """F35 F59 X39"""
    q = _points(t).select("vec_id", P.to_height(c("p"), 100).alias("q"))
    return q.select("vec_id", F.round(P.box_height(P.box(c("q"))), 4).alias("height"), F.round(F.array_max(F.transform("q", lambda v: F.abs(v["x"]))), 4).alias("reach"))


@query(f"select vec_id, len(xs) n, xs[len(xs)] lastx, 1 pens from ({POINTS})")
def pen_rows(t: Tables) -> DataFrame:
    """F60 F36 F37"""
    rows = P.pen_rows(F.array(c("p")))
    return _points(t).select("vec_id", F.size(rows).cast("bigint").alias("n"), F.element_at(rows, -1)["x"].alias("lastx"), F.aggregate(rows, F.lit(0), lambda s, r: s + r["pen"]).alias("pens"))


@query(
    f"with p as (select *, list_prepend(0.0::double, [sqrt((xs[i]-xs[i-1])**2+(ys[i]-ys[i-1])**2) for i in range(2,len(xs)+1)]) seg from ({POINTS})), q as (select *, [list_sum(seg[1:i]) for i in range(1,len(seg)+1)] cum from p), "
    "r as (select vec_id, k, xs, ys, cum, cum[len(cum)]*k/7.0 target, least(len(xs)-1, greatest(1, len(list_filter(cum, lambda m: m<=cum[len(cum)]*k/7.0)))) i from q cross join range(0,8) r(k)) "
    "select vec_id, count(*)::int n, round(sum(xs[i]+(xs[i+1]-xs[i])*w),4) sx, round(sum(ys[i]+(ys[i+1]-ys[i])*w),4) sy from (select *, case when cum[i+1]=cum[i] then 0.0 else (target-cum[i])/(cum[i+1]-cum[i]) end w from r) group by vec_id"
)
def resample(t: Tables) -> DataFrame:
    """Eight points at equal arc lengths, the ends included."""
    q = _points(t).select("vec_id", P.resampled(c("p"), 8).alias("q"))
    return q.select("vec_id", F.size("q").alias("n"), F.round(P.total(F.transform("q", lambda v: v["x"])), 4).alias("sx"), F.round(P.total(F.transform("q", lambda v: v["y"])), 4).alias("sy"))


@query("select a, b, case when abs(r)>abs(k) then case when r>0 then 'up' else 'down' end when abs(k)>abs(r) then case when k>0 then 'right' else 'left' end end strict, case when abs(r)>=abs(k) and r<>0 then case when r>0 then 'up' else 'down' end when k>0 then 'right' when k<0 then 'left' end loose from (select a, b, (b-1)//3-(a-1)//3 r, (b-1)%3-(a-1)%3 k from (select n_nationkey+1 a from nation where n_nationkey<9), (select n_nationkey+1 b from nation where n_nationkey<9))")
def grid_directions(t: Tables) -> DataFrame:
    """F26, and F27 by its own rule: a tie of the axes goes to the vertical one."""
    nine = t.nation.where("n_nationkey < 9")
    return J.product(nine.select((c("n_nationkey") + 1).alias("a")), nine.select((c("n_nationkey") + 1).alias("b"))).select("a", "b", P.grid_direction(c("a"), c("b")).alias("strict"), P.grid_direction(c("a"), c("b"), vertical_wins=True).alias("loose"))


@query("select l_orderkey, l_linenumber, l_partkey, cast((2-floor(3*l_tax/0.09))*3+floor(3*l_discount/0.11)+1 as int) cell from lineitem")
def grid_cells(t: Tables) -> DataFrame:
    """P25 P28"""
    b = F.struct(F.lit(0.0).alias("x_min"), F.lit(0.0).alias("y_min"), F.lit(0.11).alias("x_max"), F.lit(0.09).alias("y_max"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", P.grid_cell(c("l_discount"), c("l_tax"), b).alias("cell"))


@query("select event_id, case when a between 60 and 120 then 'vertical' when a<=30 or a>=150 then 'horizontal' else 'diagonal' end cls from (select event_id, event_id%180 a from events)")
def segment_class(t: Tables) -> DataFrame:
    """P27 F21"""
    return t.events.select("event_id", P.segment_class(-(c("event_id") % 180)).alias("cls"))


# ---- similarity, space, graphs ----


HASHES = "select vec_id, list_sum([case when embedding[i+1]>embedding[i] then 1::hugeint<<(i-1) else 0::hugeint end for i in range(1,64)]) h from embeddings"


@query(f"with h as (select h, min(vec_id) vec_id from ({HASHES}) group by h) select a.vec_id a, b.vec_id b, bit_count(xor(a.h,b.h))::int distance from h a join h b on a.vec_id<b.vec_id where bit_count(xor(a.h,b.h))<=14")
def hamming_pairs(t: Tables) -> DataFrame:
    """Pairs of classes of equal hashes of the whole arrays."""
    return S.hamming_pairs(S.difference_hash(t.embeddings, "vec_id", "embedding", 63), "vec_id", "h", 14, 63)


@query(f"select vec_id member, min(vec_id) over (partition by h) as first from ({HASHES})")
def hash_members(t: Tables) -> DataFrame:
    """The class of each row by its hash."""
    return S.class_members(S.difference_hash(t.embeddings, "vec_id", "embedding", 63), "vec_id", "h")


@query(
    f"with recursive h as (select h, min(vec_id) born from ({HASHES}) group by h), o as (select *, row_number() over (order by born) k from h), "
    "g(k, leaders) as (select 0::bigint, []::hugeint[] union all select g.k+1, case when len(list_filter(leaders, lambda x: bit_count(xor(x, o.h))<=14))>0 then leaders else list_append(leaders, o.h) end from g join o on o.k=g.k+1), "
    "l as (select unnest(leaders) h from g where k=(select max(k) from g)), lead as (select o.born, o.h from l join o using (h)), "
    f"own as (select o.h, min(lead.born) leader from o join lead on bit_count(xor(lead.h,o.h))<=14 and lead.born<=o.born group by o.h), m as (select own.leader, v.vec_id member from ({HASHES}) v join own on own.h=v.h) "
    "select m.leader, m.member, row_number() over (partition by m.leader order by e.label desc, m.member) as rank, row_number() over (partition by m.leader order by e.label desc, m.member)=1 as keep from m join embeddings e on e.vec_id=m.member"
)
def greedy_groups(t: Tables) -> DataFrame:
    """Greedy groups and the best of each."""
    h = S.difference_hash(t.embeddings, "vec_id", "embedding", 63)
    groups = S.greedy_groups(h, "vec_id", "h", 14, "vec_id")
    return S.keep_best(groups, t.embeddings.select("vec_id", c("label").cast("double").alias("score")), "vec_id", "score", "vec_id")


@query("select a.s_suppkey id, b.s_suppkey other from supplier a join supplier b on a.s_suppkey<>b.s_suppkey where (a.s_acctbal-b.s_acctbal)**2 + (a.s_nationkey*100.0-b.s_nationkey*100.0)**2 <= 300.0**2")
def radius_join(t: Tables) -> DataFrame:
    """J22 J23 G4"""
    p = t.supplier.select(c("s_suppkey").alias("id"), c("s_acctbal").alias("x"), (c("s_nationkey") * 100.0).alias("y"))
    return G.radius_join(p, p.withColumnRenamed("id", "other"), 300.0).where("id != other").select("id", "other")


@query("select id, other from (select a.s_suppkey id, b.s_suppkey other, row_number() over (partition by a.s_suppkey order by (a.s_acctbal-b.s_acctbal)*(a.s_acctbal-b.s_acctbal) + (a.s_nationkey*100.0-b.s_nationkey*100.0)*(a.s_nationkey*100.0-b.s_nationkey*100.0), b.s_suppkey) rn from supplier a join supplier b on a.s_suppkey<>b.s_suppkey) where rn<=2")
def nearest_two(t: Tables) -> DataFrame:
    """The two nearest of every point, however far."""
    p = t.supplier.select(c("s_suppkey").alias("id"), c("s_acctbal").alias("x"), (c("s_nationkey") * 100.0).alias("y"))
    return G.nearest_all(p, p.withColumnRenamed("id", "other"), 200.0, 2).select("id", "other")


@query("select k, a from (select x.s_suppkey k, y.s_suppkey a, row_number() over (partition by x.s_suppkey order by abs(x.s_acctbal-y.s_acctbal), y.s_suppkey) rn from supplier x join supplier y on x.s_suppkey<>y.s_suppkey) t where rn=1")
def nearest_pair(t: Tables) -> DataFrame:
    """J27"""
    return G.nearest_value(t.supplier, "s_suppkey", "s_acctbal").select(c("s_suppkey").alias("k"), c("nearest").alias("a"))


@query("with p as (select distinct p_size x, p_partkey%30 y from part), e as (select a.x, a.y, count(b.x) degree from p a left join p b on abs(a.x-b.x)<=1 and abs(a.y-b.y)<=1 and not (a.x=b.x and a.y=b.y) group by a.x, a.y) select x, y, degree, case when degree=1 then 'end' when degree>=3 then 'junction' else 'path' end kind from e")
def pixel_graph(t: Tables) -> DataFrame:
    """G1 G2"""
    p = t.part.select(F.lit(1).alias("glyph"), c("p_size").alias("x"), (c("p_partkey") % 30).cast("int").alias("y")).distinct()
    return G.pixel_kinds(p, G.adjacency(p)).select("x", "y", "degree", "kind")


@query("with recursive e as (select distinct s_suppkey a, s_nationkey*1000+1000000 b from supplier), u as (select a,b from e union all select b,a from e), r(n, m) as (select a, a from u union select r.n, u.b from r join u on r.m=u.a) select n node, min(m) root from r group by n")
def connected(t: Tables) -> DataFrame:
    """G6"""
    e = t.supplier.select(c("s_suppkey").alias("a"), (c("s_nationkey") * 1000 + 1000000).cast("bigint").alias("b")).distinct()
    return G.connected(e.select(c("a").alias("node")).union(e.select("b")).distinct(), e)


@query("select n_regionkey junction, string_agg(n_nationkey::varchar, ',' order by n_nationkey) segments from nation group by n_regionkey")
def junction_index(t: Tables) -> DataFrame:
    """G10 A18"""
    s = t.nation.select(F.lit(1).alias("glyph"), c("n_nationkey").alias("segment"), c("n_regionkey").alias("start"), F.lit(-1).alias("end"))
    return G.junction_index(s).select("junction", F.array_join(F.transform("segments", lambda v: v.cast("string")), ",").alias("segments"))


# ---- sources, streams ----


@query("select doc_id, row_number() over (order by doc_id)-1 idx, lpad((row_number() over (order by doc_id)-1)::varchar, 8, '0') key from documents")
def dense_index(t: Tables) -> DataFrame:
    """The index"""
    return FS.keyed_samples(t.documents.select("doc_id"), ["doc_id"])


@query("select user_id, event_id, count(*) over w checked, sum(case when event_type='error' then 1 else 0 end) over w failed from events window w as (partition by user_id order by event_id rows between unbounded preceding and current row)")
def progress_counters(t: Tables) -> DataFrame:
    """T1"""
    return T.progress(t.events.withColumn("bad", c("event_type") == "error"), "user_id", "event_id", "bad")


@query("select o_orderkey id, count(l_orderkey) filter (l_returnflag='N')=0 complete from orders left join lineitem on l_orderkey=o_orderkey group by 1")
def queue_complete(t: Tables) -> DataFrame:
    """T7"""
    jobs = t.orders.select(c("o_orderkey").alias("id"), F.lit(True).alias("discovered"))
    staged = t.lineitem.select(c("l_orderkey").alias("job_id"), F.when(c("l_returnflag") == "N", "pending").otherwise("done").alias("status"))
    return T.queue_done(jobs, staged)


@query("select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by event_id desc) rn from events where user_id in (select user_id from events group by user_id order by max(event_id) desc, user_id limit 50)) where rn<=20")
def bounded_buffer(t: Tables) -> DataFrame:
    """T13"""
    return T.bounded_buffer(t.events.select("user_id", "event_id"), "user_id", "event_id", 50, 20)


# ---- more of the same kinds ----


@query("with p as (select vec_id, label, row_number() over (partition by label order by md5('7:'||vec_id), vec_id)-1 a, count(*) over (partition by label) n from embeddings) select x.vec_id, j k, y.vec_id other from p x cross join range(0,3) r(j) join p y on y.label=x.label and y.a=(x.a+1+j%(x.n-1))%x.n where x.n>1")
def sample_others(t: Tables) -> DataFrame:
    """X52"""
    return R.sample_others(t.embeddings, "label", "vec_id", 3, "7").select("vec_id", c("_k").alias("k"), "other")


@query("select user_id, event_type, value from (select user_id, event_type, value, row_number() over (partition by user_id order by value desc, event_type='view' desc, event_id) rn from events where value is not null) where rn=1")
def best_variant(t: Tables) -> DataFrame:
    """O12"""
    return R.best_variant(t.events.where("value is not null"), "user_id", "event_type", "value", "event_id", "view")


@query("select event_id, epoch(date_trunc('second',ts))::bigint - epoch(date_trunc('second',first_value(ts) over (partition by user_id order by event_id)))::bigint as secs from events")
def elapsed_seconds(t: Tables) -> DataFrame:
    """W15 F13 F15"""
    return t.events.select("event_id", R.elapsed("ts", "user_id", "event_id").alias("secs"))


@query("select strftime(ts, '%Y-%m-%d') as day, count(*) n from events group by 1")
def daily_counts(t: Tables) -> DataFrame:
    """F13"""
    return t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("select page_id, url_encode(url) quoted from pages where url is not null")
def quoted_urls(t: Tables) -> DataFrame:
    """F9"""
    return t.pages.where("url is not null").select("page_id", X.quote(c("url")).alias("quoted"))


@query("select page_id, replace(replace(replace(replace(replace(replace(t,'&lt;','<'),'&gt;','>'),'&quot;','\"'),'&apos;',''''),'&#39;',''''),'&amp;','&') title from (select page_id, regexp_extract(html,'<title>([^<]*)</title>',1) t from pages)")
def page_titles(t: Tables) -> DataFrame:
    """F10"""
    return t.pages.select("page_id", X.unescape(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query("select vec_id, round(list_inner_product(embedding::double[], list_reverse(embedding::double[])),5) d from embeddings")
def self_dot(t: Tables) -> DataFrame:
    """F18 F42"""
    e = c("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", F.round(P.total(F.zip_with(e, F.reverse(e), lambda x, y: x * y)), 5).alias("d"))


@query(f"select vec_id, round(list_sum([case when sqrt(xs[i]**2+ys[i]**2)<0.01 or sqrt(xs[i+1]**2+ys[i+1]**2)<0.01 then acos(0.0) else acos(greatest(-1.0,least(1.0,(xs[i]*xs[i+1]+ys[i]*ys[i+1])/(sqrt(xs[i]**2+ys[i]**2)*sqrt(xs[i+1]**2+ys[i+1]**2))))) end for i in range(1,len(xs))]),4) a from ({POINTS})")
def unit_angles(t: Tables) -> DataFrame:
    """The angles between all neighbours of a point array."""
    turn = lambda i: P.angle_between(P.normalised(F.get("p", i)), P.normalised(F.get("p", i + 1)))
    return _points(t).select("vec_id", F.round(P.total(F.transform(F.sequence(F.lit(0), F.size("p") - 2), turn)), 4).alias("a"))


@query("select n_nationkey+1 region, 10+30*(n_nationkey%3+0.5)/3 x, 20+60*((2-n_nationkey//3)+0.5)/3 y, 10+30*(n_nationkey%3)/2.0 ax, 20+60*(2-n_nationkey//3)/2.0 ay from nation where n_nationkey<9")
def cell_centres(t: Tables) -> DataFrame:
    """F24 F25"""
    b = F.struct(F.lit(10.0).alias("x_min"), F.lit(20.0).alias("y_min"), F.lit(40.0).alias("x_max"), F.lit(80.0).alias("y_max"))
    r = c("n_nationkey") + 1
    return t.nation.where("n_nationkey < 9").select(r.alias("region"), P.cell_centre(r, b)["x"].alias("x"), P.cell_centre(r, b)["y"].alias("y"), P.anchor_point(r, b)["x"].alias("ax"), P.anchor_point(r, b)["y"].alias("ay"))


@query(f"select vec_id, round((xs[1]+3*xs[2]+3*xs[3]+xs[4])/8,5) cx, round((ys[1]+2*ys[2]+ys[3])/4,5) qy from ({POINTS})")
def curve_middles(t: Tables) -> DataFrame:
    """F31 F32"""
    at = lambda i: F.get("p", F.lit(i))
    cubic, square = P.bezier([at(0), at(1), at(2), at(3)], 2), P.bezier([at(0), at(1), at(2)], 2)
    return _points(t).select("vec_id", F.round(F.get(cubic, F.lit(1))["x"], 5).alias("cx"), F.round(F.get(square, F.lit(1))["y"], 5).alias("qy"))


@query(f"select vec_id, round((-xs[1]+9*xs[2]+9*xs[3]-xs[4])/16,5) x, (len(xs)-1)*2+1 n from ({POINTS})")
def spline_middle(t: Tables) -> DataFrame:
    """the sample halfway between the second and third points."""
    s = P.catmull_rom(c("p"), 2)
    return _points(t).select("vec_id", F.round(F.get(s, F.lit(3))["x"], 5).alias("x"), F.size(s).cast("bigint").alias("n"))


@query(f"select vec_id, list_sum([greatest(1,floor(sqrt((xs[i]*100-xs[i+1]*100)**2+(ys[i]*100-ys[i+1]*100)**2)/2)::int)+1 for i in range(1,len(xs))])::bigint n from ({POINTS})")
def sampled_lines(t: Tables) -> DataFrame:
    """the samples of all segments."""
    n = lambda i: F.size(P.sampled_line(P.scaled(F.get("p", i), 100), P.scaled(F.get("p", i + 1), 100)))
    return _points(t).select("vec_id", F.aggregate(F.transform(F.sequence(F.lit(0), F.size("p") - 2), n), F.lit(0), lambda a, b: a + b).cast("bigint").alias("n"))


@query(f"select vec_id, round(xs[len(xs)]-xs[len(xs)-4],5) dx, round(ys[5]-ys[1],5) dy from ({POINTS})")
def end_directions(t: Tables) -> DataFrame:
    """W13"""
    p = c("p")
    return _points(t).select("vec_id", F.round(F.element_at(p, -1)["x"] - F.element_at(p, -5)["x"], 5).alias("dx"), F.round(F.element_at(F.slice(p, 1, 5), -1)["y"] - F.element_at(p, 1)["y"], 5).alias("dy"))


@query("select vec_id, len(list_distinct(list_concat(a,b))) u, len(list_intersect(list_distinct(a),b)) i, len(a)+len(b) f from (select vec_id, list_transform(embedding[1:40], lambda v: floor(v*100)::int) a, list_transform(embedding[25:64], lambda v: floor(v*100)::int) b from embeddings)")
def set_operations(t: Tables) -> DataFrame:
    """U4 U5 U6"""
    cell = lambda v: F.floor(v * F.lit(100).cast("float")).cast("int")  # noqa: E731  in single precision, as the array is
    a, b = F.transform(F.slice("embedding", 1, 40), cell), F.transform(F.slice("embedding", 25, 40), cell)
    return t.embeddings.select("vec_id", F.size(F.array_union(a, b)).cast("bigint").alias("u"), F.size(F.array_intersect(a, b)).cast("bigint").alias("i"), F.size(F.flatten(F.array(a, b))).cast("bigint").alias("f"))


@query("select event_id, '{\"type\":\"' || event_type || '\",\"user\":\"' || user_id || '\"}' details from events")
def detail_rows(t: Tables) -> DataFrame:
    """F47"""
    m = F.create_map(F.lit("type"), c("event_type"), F.lit("user"), c("user_id").cast("string"), F.lit("reason"), F.lit("x"))
    return t.events.select("event_id", X.details(m, ["reason"]).alias("details"))


@query("select event_id, cast(json_extract(props,'$.k') as bigint) k from events")
def result_blocks(t: Tables) -> DataFrame:
    """S30"""
    out = F.concat(F.lit("log\nRESULTS_START\n"), c("props"), F.lit("\nRESULTS_END\nbye"))
    return t.events.select("event_id", X.result_block(out, "k bigint")["k"].alias("k"))


@query("select l_orderkey, l_linenumber, l_partkey, greatest(10.0,least(40.0,l_quantity)) q, round(1/(1+exp(-l_quantity/10)),6) s from lineitem")
def clipped(t: Tables) -> DataFrame:
    """F55 F56"""
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", X.clip(c("l_quantity"), 10.0, 40.0).alias("q"), F.round(X.sigmoid(c("l_quantity") / 10), 6).alias("s"))


@query("select p_partkey, round(0.4*a+0.3*b+0.1*a+0.1*b+0.1*a,6) quality, round(0.2*a+0.25*b+0.2*(1-a)+0.2*b+0.15*a,6) handwriting, round(0.4*a+0.3*b+0.3*a,6) charset from (select p_partkey, p_size/50.0 a, (p_size%10)/10.0 b from part)")
def weighted_scores(t: Tables) -> DataFrame:
    """A20 A23 A24"""
    a, b = c("p_size") / 50.0, c("p_size") % 10 / 10.0
    m = {"ocr_confidence": a, "ocr_correct": b, "smoothness": a, "completeness": b, "aspect_ratio": a, "baseline_variation": a, "stroke_width_variation": b, "character_consistency": a, "edge_roughness": b, "slant_variation": a, "charset": a, "consistency": b, "legibility": a}
    rows = t.part.select("p_partkey", *[v.alias(k) for k, v in m.items()])
    return rows.select("p_partkey", F.round(A.weighted(A.QUALITY_SCORE), 6).alias("quality"), F.round(A.weighted(A.HANDWRITING_SCORE, ["character_consistency"]), 6).alias("handwriting"), F.round(A.weighted(A.CHARSET_SCORE), 6).alias("charset"))


@query("select p_partkey x, p_size y from part where p_partkey%2=0 and p_size%2=0")
def point_cloud(t: Tables) -> DataFrame:
    """X36"""
    from ..functions.glyphs import cloud_points

    return cloud_points(t.part.select(c("p_partkey").alias("x"), c("p_size").alias("y")))


@query("select s_suppkey, s_name, s_nationkey, s_acctbal, null::int page from supplier")
def added_column(t: Tables) -> DataFrame:
    """D24 D25"""
    from ..schemas import migrate

    return migrate(t.supplier, {"page": "int", "s_name": "string"})


@query("select c_custkey, substr(md5('f:'||c_custkey),1,12) k from customer where substr(md5('f:'||c_custkey),1,12) not in (select substr(md5('f:'||s_suppkey),1,12) from supplier)")
def missing_keys(t: Tables) -> DataFrame:
    """What an incremental sink would still write."""
    done = t.supplier.select(X.content_key(F.lit("f"), c("s_suppkey").cast("string")).alias("k"))
    return t.customer.select("c_custkey", X.content_key(F.lit("f"), c("c_custkey").cast("string")).alias("k")).join(done, "k", "left_anti").select("c_custkey", "k")


@query("select user_id, round(avg(d2*d2),3) bend from (select user_id, lead(value) over w - 2*value + lag(value) over w d2 from events window w as (partition by user_id order by event_id)) where d2 is not null group by user_id")
def bending_energy(t: Tables) -> DataFrame:
    """W14"""
    d2 = t.events.select("user_id", R.second_difference("value", "user_id", ["event_id"]).alias("d2")).where("d2 is not null")
    return d2.groupBy("user_id").agg(F.round(F.avg(c("d2") * c("d2")), 3).alias("bend"))


@query("select junction, count(*) n from (select l_suppkey junction from lineitem where l_returnflag='A' union all select l_partkey from lineitem where l_returnflag='R') group by 1")
def union_all_counts(t: Tables) -> DataFrame:
    """U1 U6"""
    a, b = t.lineitem.where("l_returnflag = 'A'").select(c("l_suppkey").alias("junction")), t.lineitem.where("l_returnflag = 'R'").select("l_partkey")
    return a.union(b).groupBy("junction").agg(F.count("*").alias("n"))
