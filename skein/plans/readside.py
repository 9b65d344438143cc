"""The analytical read side over the star tables: versions, facets, funnels, gaps, families, units, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import numbers as N
from skein.functions import text as T
from skein.operators import graph as G
from skein.operators import ranking as R
from skein.sources import tables as S
from skein.sources.tables import table

from .registry import register
from .text import TITLE_SQL, TRI, titles

LATEST = "l as (select * from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) where r = 1)"


def latest_orders(spark: SparkSession, d: str) -> DataFrame:
    return R.latest(table(spark, d, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))


@register("latest_version", f"with {LATEST} select o_custkey, o_orderkey, o_orderstatus from l")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    return latest_orders(spark, d).select("o_custkey", "o_orderkey", "o_orderstatus")


@register("a29_next_version", "select o_custkey, count(*) + 1 as next_version, max(o_orderkey) + 1 as next_key from orders group by 1")
def next_version(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg((F.count(F.lit(1)) + 1).alias("next_version"), (F.max("o_orderkey") + 1).alias("next_key"))


@register("latest_per_position", r"with p as (select page_id, regexp_extract(url, '/([0-9]+)', 1) as pos from pages), r as (select *, row_number() over (partition by pos order by page_id desc) as r from p where pos <> '') select page_id, pos from r where r = 1 union all select page_id, null from p where pos = ''")
def latest_per_position(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "/([0-9]+)", 1).alias("pos"))
    last = p.filter("pos <> ''").groupBy("pos").agg(F.max("page_id").alias("page_id"))
    return last.select("page_id", "pos").unionByName(p.filter("pos = ''").select("page_id", F.lit(None).cast("string").alias("pos")))


FACET = "with x as (select coalesce(nullif({c}, ''), '(not stated)') as value, count(*) as n from {t} group by 1), r as (select value, n, row_number() over (order by n desc, value) as rank from x where value <> '(not stated)') select value, n::bigint as n, rank::bigint as rank from r where rank <= {k} union all select '(other)', sum(n)::bigint, {k} + 1 from r where rank > {k} having sum(n) is not null union all select value, n, {k} + 2 from x where value = '(not stated)'"
SEGMENT = "case when c_custkey % 7 = 0 then '' when c_custkey % 11 = 0 then null else c_mktsegment || (c_custkey % 4) end"


@register("facet_counts", FACET.format(c="s", t=f"(select {SEGMENT} as s from customer)", k=12))
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    s = F.when(key % 7 == 0, "").when(key % 11 == 0, F.lit(None)).otherwise(F.concat("c_mktsegment", (key % 4).cast("string")))
    return R.facet(table(spark, d, "customer").select(s.alias("s")), "s", 12).withColumn("rank", F.col("rank").cast("long"))


@register("a4_filtered_counts", "select o_orderstatus, count(*) as n, count(*) filter (where o_totalprice > 200000) as large, count(*) filter (where o_orderpriority like '1%') as urgent from orders group by 1")
def filtered_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 200000).alias("large"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"))


FUNNEL = f"""with {LATEST}, items as (select distinct l_orderkey from lineitem), returned as (select distinct l_orderkey from lineitem where l_returnflag = 'R'),
 s as (select (select count(*) from customer) as a, (select count(distinct o_custkey) from orders where o_custkey in (select c_custkey from customer)) as b, (select count(*) from l where o_orderkey in (select l_orderkey from items)) as c, (select count(*) from l where o_orderstatus = 'F') as e, (select count(*) from l where o_orderstatus = 'F' and o_orderkey not in (select l_orderkey from returned)) as f)
 select stage, step, n, coalesce(lag(n) over (order by step) - n, 0) as lost from (select 'entities' as stage, 1 as step, a as n from s union all select 'with_versions', 2, b from s union all select 'with_lineage', 3, c from s union all select 'final', 4, e from s union all select 'clean', 5, f from s)"""


@register("funnel", FUNNEL)
def funnel(spark: SparkSession, d: str) -> DataFrame:
    """Stages that reconcile: each is a count over left-semi or left-anti joins, unpivoted into rows."""
    cust, orders, items = table(spark, d, "customer"), table(spark, d, "orders"), table(spark, d, "lineitem")
    last = latest_orders(spark, d)
    lines = items.select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    back = items.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    final = last.filter("o_orderstatus = 'F'")
    row = one(cust, "a")
    for df, name in (
        (orders.select(F.col("o_custkey").alias("c_custkey")).distinct().join(cust, "c_custkey", "left_semi"), "b"),
        (last.join(lines, "o_orderkey", "left_semi"), "c"),
        (final, "e"),
        (final.join(back, "o_orderkey", "left_anti"), "f"),
    ):
        row = row.crossJoin(F.broadcast(one(df, name)))
    stages = row.selectExpr("stack(5, 'entities', 1, a, 'with_versions', 2, b, 'with_lineage', 3, c, 'final', 4, e, 'clean', 5, f) as (stage, step, n)")
    return stages.withColumn("lost", F.coalesce(F.lag("n").over(Window.orderBy("step")) - F.col("n"), F.lit(0)))


GAP = f"""with {LATEST}, t as (select c_custkey, c_nationkey, c_mktsegment, c_acctbal, c_custkey in (select o_custkey from orders) as has, count(*) over (partition by c_nationkey) as peers from customer)
 select bucket, count(*) as n from (select case when has then 'in_role' when c_acctbal < 0 then 'no_title' when c_mktsegment = 'FURNITURE' then 'furniture' when peers = 1 then 'one_off' when c_custkey % 2 = 0 then 'dup_of_kept' else 'should_have_clustered' end as bucket from t) group by 1"""


@register("gap_buckets", GAP)
def gap_buckets(spark: SparkSession, d: str) -> DataFrame:
    has = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(True))
    cust = table(spark, d, "customer")
    peers = cust.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("peers"))
    t = cust.join(has, "c_custkey", "left").join(peers, "c_nationkey")
    bucket = (
        F.when(F.col("has"), "in_role").when(F.col("c_acctbal") < 0, "no_title").when(F.col("c_mktsegment") == "FURNITURE", "furniture")
        .when(F.col("peers") == 1, "one_off").when(F.col("c_custkey") % 2 == 0, "dup_of_kept").otherwise("should_have_clustered")
    )
    return t.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@register("singleton_buckets", "with s as (select p_partkey, split_part(p_name, ' ', 1) || ' ' || p_brand as stem, p_size <= 10 as in_role from part), w as (select stem, count(*) as n, bool_or(in_role) as any_role from s group by 1) select case when n = 1 then 'unique' when any_role then 'shares_with_role' else 'shares_with_orphan' end as bucket, count(*) filter (where not in_role) as pool, count(*) filter (where in_role) as control from s join w using (stem) group by 1")
def singleton_buckets(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(1)), "p_brand").alias("stem"), (F.col("p_size") <= 10).alias("in_role"))
    w = s.groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.bool_or("in_role").alias("any_role"))
    bucket = F.when(F.col("n") == 1, "unique").when(F.col("any_role"), "shares_with_role").otherwise("shares_with_orphan")
    return s.join(w, "stem").groupBy(bucket.alias("bucket")).agg(F.count_if(~F.col("in_role")).alias("pool"), F.count_if("in_role").alias("control"))


@register("unit_rollup", "select r_regionkey as unit, r_name as name, count(c_custkey) as in_unit, (select count(*) from customer) - count(c_custkey) as not_in_unit from region left join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by 1, 2")
def unit_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Members of every unit and of all units below it, through the closure of the hierarchy."""
    region, nation, cust = (table(spark, d, t) for t in ("region", "nation", "customer"))
    up = nation.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child"))
    below = G.descendants(up)
    n = cust.groupBy(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("node")).agg(F.count(F.lit(1)).alias("n"))
    total = below.join(n, "node").groupBy("ancestor").agg(F.sum("n").alias("in_unit"))
    every = cust.agg(F.count(F.lit(1)).alias("all"))
    out = region.join(total, F.concat(F.lit("r"), F.col("r_regionkey").cast("string")) == F.col("ancestor"), "left").crossJoin(F.broadcast(every))
    return out.select(F.col("r_regionkey").alias("unit"), F.col("r_name").alias("name"), F.coalesce("in_unit", F.lit(0)).alias("in_unit"), (F.col("all") - F.coalesce("in_unit", F.lit(0))).alias("not_in_unit"))


FAMILY = f"t as (select p_partkey, p_size, p_brand, {TITLE_SQL} as title from part), sig as (select p_partkey from t where contains(lower(title), 'director') union select p_partkey from t where p_brand = 'Brand#1' union select p_partkey from part where p_size = 7)"


@register("family_membership", f"with {FAMILY} select p_partkey from (select p_partkey from sig union select p_partkey from t where p_partkey % 97 = 0) where p_partkey % 13 <> 0")
def family_membership(spark: SparkSession, d: str) -> DataFrame:
    """Signals or inclusions, less exclusions, which come last."""
    t = titles(spark, d).join(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    signal = F.contains(F.lower("title"), F.lit("director")) | (F.col("p_brand") == "Brand#1") | (F.col("p_size") == 7)
    member = t.filter(signal).select("p_partkey").unionByName(t.filter("p_partkey % 97 = 0").select("p_partkey")).distinct()
    return member.join(t.filter("p_partkey % 13 = 0").select("p_partkey"), "p_partkey", "left_anti")


@register("family_coverage", "select p_brand, bool_or(l_quantity > 45) as large, bool_or(l_returnflag = 'R') as returned, bool_and(coalesce(l_tax = 0, true)) as blind, count(distinct p_partkey) as parts from part left join lineitem on l_partkey = p_partkey group by 1")
def family_coverage(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.bool_or(F.col("l_quantity") > 45).alias("a"), F.bool_or(F.col("l_returnflag") == "R").alias("b"), F.bool_and(F.coalesce(F.col("l_tax") == 0, F.lit(True))).alias("z"))
    j = table(spark, d, "part").join(items, F.col("p_partkey") == F.col("l_partkey"), "left")
    return j.groupBy("p_brand").agg(F.bool_or("a").alias("large"), F.bool_or("b").alias("returned"), F.bool_and(F.coalesce("z", F.lit(True))).alias("blind"), F.countDistinct("p_partkey").alias("parts"))


TERMS = ("director", "chief", "manager", "lead", "associate")


@register("family_candidates", f"with t as (select p_partkey, {TITLE_SQL} as title from part), h as (select p_partkey, title, " + " + ".join(f"contains(lower(title), '{x}')::int" for x in TERMS) + " as hits from t) select p_partkey, title, hits, rank from (select *, row_number() over (order by hits desc, title, p_partkey) as rank from h where hits >= 1) where rank <= 200")
def family_candidates(spark: SparkSession, d: str) -> DataFrame:
    hits = F.size(F.filter(F.array(*[F.lit(x) for x in TERMS]), lambda x: F.contains(F.lower("title"), x)))
    h = titles(spark, d).select("p_partkey", "title", hits.alias("hits")).filter("hits >= 1").orderBy(F.desc("hits"), "title", "p_partkey").limit(200)
    return h.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("hits"), "title", "p_partkey")))


_SIM = f"len(list_intersect({TRI.format('title')}, {TRI.format(chr(39) + 'director' + chr(39))})) / len(list_distinct(list_concat({TRI.format('title')}, {TRI.format(chr(39) + 'director' + chr(39))})))"
HYBRID = f"""with t as (select p_partkey, p_size, {TITLE_SQL} as title from part), p0 as (select p_partkey, 'title' as matched_by, 0 as pass_no, row_number() over (order by case when lower(title) = 'director' then 0 when starts_with(lower(title), 'director') then 1 else 2 end, lower(title), p_partkey) as rank from t where contains(lower(title), 'director')),
 p1 as (select p_partkey, 'keyword' as matched_by, 1 as pass_no, row_number() over (order by lower(title), p_partkey) as rank from t where contains(lower(title), 'chief')),
 p2 as (select p_partkey, 'meaning' as matched_by, 2 as pass_no, row_number() over (order by s desc, vec_id) as rank from (select vec_id as p_partkey, vec_id, list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)) as s from embeddings order by s desc, vec_id limit 20) where p_partkey in (select p_partkey from t)),
 u as (select * from p0 union all select * from p1 union all select * from p2)
 select p_partkey, matched_by from (select *, row_number() over (partition by p_partkey order by pass_no, rank) as r from u) where r = 1"""


@register("hybrid_search", HYBRID)
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Title tiers, then a keyword's matches, then the nearest vectors; each row by its first pass."""
    t, e = titles(spark, d), table(spark, d, "embeddings")
    first = t.withColumn("tier", R.title_tier(F.col("title"), "director")).filter("tier is not null").withColumn("k", F.lower("title"))
    p0 = S.numbered(first, "tier", "k", "p_partkey").select("p_partkey", F.lit("title").alias("matched_by"), F.col("_i").alias("rank"))
    word = t.filter(T.contains_ci(F.col("title"), "chief")).withColumn("k", F.lower("title"))
    p1 = S.numbered(word, "k", "p_partkey").select("p_partkey", F.lit("keyword").alias("matched_by"), F.col("_i").alias("rank"))
    near = R.top_k_cosine(e, e.filter("vec_id = 0").select("embedding").first()[0], 20)
    p2 = near.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id"))).select(F.col("vec_id").alias("p_partkey"), F.lit("meaning").alias("matched_by"), F.col("rank").cast("long").alias("rank")).join(t.select("p_partkey"), "p_partkey", "left_semi")
    return R.merged_passes([p0, p1, p2], "p_partkey").select("p_partkey", "matched_by")


@register("review_queue", "select o_orderkey, row_number() over (order by o_orderstatus <> 'P', o_orderdate, o_orderkey) as place from orders")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """Blocked first, oldest first, as an explicit place; the order is made by ranges, not in one task."""
    q = table(spark, d, "orders").select("o_orderkey", "o_orderdate", (F.col("o_orderstatus") != "P").alias("rest"))
    return S.numbered(q, "rest", "o_orderdate", "o_orderkey").select("o_orderkey", (F.col("_i") + 1).alias("place"))


@register("o4_nulls_last_page", "select o_orderkey, p from (select o_orderkey, case when o_orderkey % 5 = 0 then null else o_totalprice end as p from orders) order by p desc nulls last, o_orderkey limit 50 offset 100")
def nulls_last_page(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).otherwise(F.col("o_totalprice"))
    return table(spark, d, "orders").select("o_orderkey", p.alias("p")).orderBy(F.desc_nulls_last("p"), "o_orderkey").offset(100).limit(50)


@register("carry_through", "with o as (select l_orderkey, l_returnflag as form, l_linenumber, l_quantity from lineitem), k as (select o_orderkey from orders where o_orderstatus = 'F') select form, count(*) as offered, count(k.o_orderkey) as kept, case when count(*) = 0 then 0.0 else round(count(k.o_orderkey) / count(*), 4) end as retention from o left join k on l_orderkey = o_orderkey group by 1")
def carry_through(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("k"))
    g = table(spark, d, "lineitem").join(kept, "l_orderkey", "left").groupBy(F.col("l_returnflag").alias("form")).agg(F.count(F.lit(1)).alias("offered"), F.count("k").alias("kept"))
    return g.withColumn("retention", N.rate(F.col("kept"), F.col("offered")))


@register("rewrite_health", "select l_linestatus, count(*) filter (where l_discount > 0.05) as rewritten, count(*) filter (where l_discount > 0.05 and l_tax > 0.04) as rewritten_kept, count(*) filter (where l_discount <= 0.05) as control, count(*) filter (where l_discount <= 0.05 and l_tax > 0.04) as control_kept, round(count(*) filter (where l_discount > 0.05 and l_tax > 0.04) / nullif(count(*) filter (where l_discount > 0.05), 0), 4) as rate, round(count(*) filter (where l_discount <= 0.05 and l_tax > 0.04) / nullif(count(*) filter (where l_discount <= 0.05), 0), 4) as control_rate from lineitem group by 1")
def rewrite_health(spark: SparkSession, d: str) -> DataFrame:
    new, kept = F.col("l_discount") > 0.05, F.col("l_tax") > 0.04
    g = table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.count_if(new).alias("rewritten"), F.count_if(new & kept).alias("rewritten_kept"), F.count_if(~new).alias("control"), F.count_if(~new & kept).alias("control_kept"))
    return g.withColumn("rate", N.rate(F.col("rewritten_kept"), F.col("rewritten"))).withColumn("control_rate", N.rate(F.col("control_kept"), F.col("control")))


@register("lineage", "select o_orderkey, count(l_orderkey) as n, coalesce(string_agg(l_partkey::varchar, ',' order by l_linenumber, l_partkey), '') as parts from orders left join lineitem on l_orderkey = o_orderkey group by 1")
def lineage(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))
    o = table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("parts", F.lit("")).alias("parts"))


@register("j6_lineage_documents", "select o_orderkey, l_linenumber, p_name from orders left join lineitem on l_orderkey = o_orderkey left join part on p_partkey = l_partkey")
def lineage_documents(spark: SparkSession, d: str) -> DataFrame:
    """Lineage arrays unnested with their elements' rows; an empty array keeps its record."""
    arrays = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_linenumber", "l_partkey")).alias("a"))
    flat = table(spark, d, "orders").select("o_orderkey").join(arrays, "o_orderkey", "left").select("o_orderkey", F.explode_outer("a").alias("x")).select("o_orderkey", "x.l_linenumber", F.col("x.l_partkey").alias("p_partkey"))
    return flat.join(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", "left").select("o_orderkey", "l_linenumber", "p_name")


@register("j3_semi_anti", "select count(*) filter (where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')) as returned, count(*) filter (where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')) as clean from orders")
def semi_anti(spark: SparkSession, d: str) -> DataFrame:
    o, r = table(spark, d, "orders"), table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    a = o.join(r, "o_orderkey", "left_semi").agg(F.count(F.lit(1)).alias("returned"))
    return a.crossJoin(F.broadcast(o.join(r, "o_orderkey", "left_anti").agg(F.count(F.lit(1)).alias("clean"))))


@register("p6_scope_selects", "select c_nationkey, count(*) as n from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 1) group by 1")
def scope_selects(spark: SparkSession, d: str) -> DataFrame:
    """A scope is a table of ids: none given is everything, an empty one nothing."""
    scope = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, d, "customer").join(scope, "c_nationkey", "left_semi").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@register("p9_first_failing_reason", "select coalesce(reason, 'admitted') as reason, count(*) as n from (select case when o_orderstatus = 'P' then 'pending' when o_totalprice < 50000 then 'small' when o_orderpriority like '5%' then 'low_priority' end as reason from orders) group by 1")
def first_failing(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.edges import admitted

    reasons = [("pending", F.col("o_orderstatus") == "P"), ("small", F.col("o_totalprice") < 50000), ("low_priority", F.col("o_orderpriority").startswith("5"))]
    return admitted(table(spark, d, "orders"), reasons).groupBy(F.coalesce("drop_reason", F.lit("admitted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@register("c19_review_states", f"with {LATEST}, o as (select o.o_custkey, o.o_orderkey, o.o_orderstatus, l.o_orderkey as last from orders o join l using (o_custkey)) select o_custkey, o_orderkey, case when o_orderkey = last and o_orderstatus = 'F' then 'published' when o_orderkey = last and o_orderstatus = 'P' then 'draft' when o_orderkey = last then 'rejected' else 'archived' end as status from o")
def review_states(spark: SparkSession, d: str) -> DataFrame:
    """The state of every version after its events: only the latest can be a draft or published."""
    o = table(spark, d, "orders")
    last = o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last"))
    own = F.col("o_orderkey") == F.col("last")
    status = F.when(own & (F.col("o_orderstatus") == "F"), "published").when(own & (F.col("o_orderstatus") == "P"), "draft").when(own, "rejected").otherwise("archived")
    return o.join(last, "o_custkey").select("o_custkey", "o_orderkey", status.alias("status"))


@register("c18_duplicate_guard", f"with t as (select p_partkey, {TITLE_SQL} as title from part) select lower(title) as title, count(*) as collisions, min(p_partkey) as first_role from t where p_partkey % 10 <> 8 group by 1 having count(*) > 1")
def duplicate_guard(spark: SparkSession, d: str) -> DataFrame:
    t = titles(spark, d).filter("p_partkey % 10 <> 8")
    return t.groupBy(F.lower("title").alias("title")).agg(F.count(F.lit(1)).alias("collisions"), F.min("p_partkey").alias("first_role")).filter("collisions > 1")


@register("c20_producer_outcomes", "with l as (select o_custkey, max_by(o_orderstatus, o_orderkey) as status, max_by(o_totalprice, o_orderkey) as price from orders group by 1) select outcome, count(*) as n from (select case when status = 'P' then 'reviewer_touched' when price < 30000 then 'recently_refreshed' when price > 250000 then 'would_downgrade' when status is null then 'created' else 'updated' end as outcome from customer left join l on o_custkey = c_custkey) group by 1")
def producer_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What a producer pass does with each record: the first reason to skip, else create or update."""
    last = table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"), F.max_by("o_totalprice", "o_orderkey").alias("price"))
    c = table(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    outcome = F.when(F.col("status") == "P", "reviewer_touched").when(F.col("price") < 30000, "recently_refreshed").when(F.col("price") > 250000, "would_downgrade").when(F.col("status").isNull(), "created").otherwise("updated")
    return c.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@register("c23_archive_browser", "select page_id from pages where contains(lower(url), '/en/') or page_id in (select doc_id from documents where contains(lower(text), 'license'))")
def archive_browser(spark: SparkSession, d: str) -> DataFrame:
    """Either signal: a union of two plans, not a join on an OR."""
    p = table(spark, d, "pages").select("page_id", "url")
    hit = table(spark, d, "documents").filter(T.contains_ci(F.col("text"), "license")).select(F.col("doc_id").alias("page_id"))
    return p.filter(T.contains_ci(F.col("url"), "/en/")).select("page_id").unionByName(p.join(hit, "page_id", "left_semi").select("page_id")).distinct()


@register("c24_drafts_list", f"with {LATEST} select o_custkey, o_orderkey, row_number() over (order by o_orderdate desc, o_orderkey desc) as place from l where o_orderstatus = 'P'")
def drafts_list(spark: SparkSession, d: str) -> DataFrame:
    p = latest_orders(spark, d).filter("o_orderstatus = 'P'").select("o_custkey", "o_orderkey", (-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("t"), (-F.col("o_orderkey")).alias("k"))
    return S.numbered(p, "t", "k").select("o_custkey", "o_orderkey", (F.col("_i") + 1).alias("place"))


@register("u5_signal_sets", "select p_partkey from part where p_size < 10 union select p_partkey from part where p_brand = 'Brand#2' except select p_partkey from part where p_retailprice > 1500")
def signal_sets(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    one = p.filter("p_size < 10").select("p_partkey").unionByName(p.filter("p_brand = 'Brand#2'").select("p_partkey")).distinct()
    return one.join(p.filter("p_retailprice > 1500").select("p_partkey"), "p_partkey", "left_anti")
