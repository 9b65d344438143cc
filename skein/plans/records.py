"""Parsing, facets, joins and checks that the other modules don't show, over all tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import records as P
from skein.functions import text as T
from skein.operators import embedding as V
from skein.operators import ranking as R
from skein.sources.tables import table

from .registry import register
from .text import TITLE_SQL, titles

Q = "'"


@register("s6_paired_cells", "with l as (select doc_id, unnest(string_split(text, chr(10))) as l from documents), c as (select doc_id, list_transform(string_split(l, '|'), lambda x: trim(x)) as c from l where contains(l, '|')) select doc_id, sum(len(range(0, len(c), 2)))::bigint as entries, sum(length(array_to_string(list_transform(range(0, len(c), 2), lambda i: case when i + 2 <= len(c) then c[i+1] || ': ' || c[i+2] else c[i+1] end), chr(10))))::bigint as chars from c group by 1")
def paired(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l")).filter(F.contains("l", F.lit("|")))
    e = lines.select("doc_id", P.paired_cells(F.col("l")).alias("e"))
    return e.groupBy("doc_id").agg(F.sum(F.size("e")).alias("entries"), F.sum(F.length(F.array_join("e", "\n"))).alias("chars"))


@register("s10_ledger_keeps_unreadable", "select case when text is null or trim(text) = '' then 'unreadable' when length(text) > 20000 then 'too_large' else 'read' end as status, count(*) as n from documents group by 1")
def ledger(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("text").isNull() | (F.trim("text") == ""), "unreadable").when(F.length("text") > 20000, "too_large").otherwise("read")
    return table(spark, d, "documents").groupBy(s.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@register("p5_asymmetric_scope", "select form, count(*) as n from (select 'include' as form from customer where coalesce(c_mktsegment in ('BUILDING'), false) union all select 'exclude' from customer where not coalesce(c_mktsegment in ('BUILDING'), false)) group by 1")
def asymmetric_scope(spark: SparkSession, d: str) -> DataFrame:
    inside = F.coalesce(F.col("c_mktsegment").isin("BUILDING"), F.lit(False))
    return table(spark, d, "customer").groupBy(F.when(inside, "include").otherwise("exclude").alias("form")).agg(F.count(F.lit(1)).alias("n"))


@register("p11_code_in_name", "select page_id from pages where regexp_matches(url, '(^|[^A-Za-z])(en|fr)([^a-z]|$)')")
def code_in_name(spark: SparkSession, d: str) -> DataFrame:
    """A code with no letter before it and no lower-case one after; look-arounds where the engine has them."""
    return table(spark, d, "pages").filter(F.col("url").rlike("(?<![A-Za-z])(en|fr)(?![a-z])")).select("page_id")


@register("p12_anchored_terms", "select doc_id, " + ", ".join(f"regexp_matches(lower(text), '(^|[^a-z0-9]){t}([^a-z0-9]|$)') as has_{t}" for t in ("stupid", "license", "token")) + " from documents")
def anchored_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *[F.lower("text").rlike(f"(?<![a-z0-9]){t}(?![a-z0-9])").alias(f"has_{t}") for t in ("stupid", "license", "token")])


@register("p17_reserved_phrase", f"select p_partkey, contains(lower({TITLE_SQL}), 'chief officer') or contains(lower({TITLE_SQL}), 'office of the director') as reserved from part")
def reserved(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower("title")
    return titles(spark, d).select("p_partkey", (F.contains(t, F.lit("chief officer")) | F.contains(t, F.lit("office of the director"))).alias("reserved"))


@register("p18_comparable_stamps", "select label as stamp, count(*) as n, label = 3 as live from embeddings group by 1")
def stamps(spark: SparkSession, d: str) -> DataFrame:
    """How many vectors each stamp has; only those of the live one are compared."""
    return table(spark, d, "embeddings").groupBy(F.col("label").alias("stamp")).agg(F.count(F.lit(1)).alias("n")).withColumn("live", F.col("stamp") == 3)


@register("p19_template_of", "select case when c_mktsegment = 'MACHINERY' then 'wjq' else 'jdfn' end as template, count(*) as n from customer group by 1")
def template_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy(F.when(F.col("c_mktsegment").eqNullSafe("MACHINERY"), "wjq").otherwise("jdfn").alias("template")).agg(F.count(F.lit(1)).alias("n"))


@register("p21_review_predicates", "select o_orderkey, o_orderstatus = 'P' as touched, o_totalprice < avg(o_totalprice) over (partition by o_custkey) as would_downgrade from orders")
def review_predicates(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "P").alias("touched"), (F.col("o_totalprice") < F.avg("o_totalprice").over(w)).alias("would_downgrade"))


def guarded(keywords: list[str], known: set[str], most: int = 3) -> list[str]:
    """A query plan's keywords as far as they are known, without repeats, up to a limit."""
    return list(dict.fromkeys(k.lower() for k in keywords if k.lower() in known))[:most]


@register("p26_query_guard", f"select p_partkey from part where contains(lower({TITLE_SQL}), 'director') or contains(lower({TITLE_SQL}), 'chief')")
def query_guard(spark: SparkSession, d: str) -> DataFrame:
    out = F.lit(False)
    for k in guarded(["Director", "wizard", "chief", "director"], {"director", "chief", "lead"}):
        out = out | T.contains_ci(F.col("title"), k)
    return titles(spark, d).filter(out).select("p_partkey")


@register("j1_labelled_documents", "select d.doc_id, d.lang, l.quality, l.toxic from documents d join labels l using (doc_id)")
def labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "lang", "quality", "toxic")


@register("j5_orphans_near_kept", "with e as (select l_partkey as a, l_suppkey as b from lineitem group by 1, 2), k as (select p_partkey from part where p_size > 25) select count(distinct a) as orphans from e where a not in (select p_partkey from k) and b in (select b from e where a in (select p_partkey from k))")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    """Orphans that share a neighbour with a kept node: two semi-joins over exploded ends, no join on an OR."""
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    kept = table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("a"))
    near = e.join(kept, "a", "left_semi").select("b").distinct()
    return e.join(kept, "a", "left_anti").join(near, "b", "left_semi").agg(F.countDistinct("a").alias("orphans"))


@register("j15_carried_clusters", "select count(*) as n from (select o_custkey from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity >= 49) group by 1)")
def carried(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("k")).select("o_custkey", F.explode("k").alias("l_orderkey"))
    hit = table(spark, d, "lineitem").filter("l_quantity >= 49").select("l_orderkey").distinct()
    return o.join(hit, "l_orderkey", "left_semi").select("o_custkey").distinct().agg(F.count(F.lit(1)).alias("n"))


@register("j16_documents_to_roles", "select o_custkey as role, count(distinct l_partkey) as documents from orders join lineitem on l_orderkey = o_orderkey where l_shipdate >= timestamp '1996-01-01' group by 1")
def to_roles(spark: SparkSession, d: str) -> DataFrame:
    """Hits on members collapse into what holds them: members are exploded once and joined by key."""
    items = table(spark, d, "lineitem").filter(F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz")).select("l_orderkey", "l_partkey")
    return table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("role")).agg(F.countDistinct("l_partkey").alias("documents"))


@register("j18_ladder_lookup", "select c_custkey, case c_mktsegment when 'BUILDING' then 1 when 'AUTOMOBILE' then 2 when 'MACHINERY' then 3 end as band from customer")
def ladder_lookup(spark: SparkSession, d: str) -> DataFrame:
    band = F.create_map(*[F.lit(x) for kv in {"BUILDING": 1, "AUTOMOBILE": 2, "MACHINERY": 3}.items() for x in kv])
    return table(spark, d, "customer").select("c_custkey", F.try_element_at(band, F.col("c_mktsegment")).alias("band"))


@register("j19_probe_misses", "select count(*) filter (where l.doc_id is not null) as probed, count(*) filter (where l.doc_id is null) as skipped from documents d left join labels l using (doc_id)")
def probe_misses(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", F.lit(1).alias("hit")), "doc_id", "left")
    return j.agg(F.count("hit").alias("probed"), F.count_if(F.col("hit").isNull()).alias("skipped"))


@register("j20_vouched_positions", "with p as (select page_id, unnest(regexp_extract_all(url, '[0-9]{2,}')) as pos from pages), v as (select pos from p group by 1 having count(distinct page_id) >= 2) select page_id, pos from p where pos in (select pos from v) group by 1, 2")
def vouched(spark: SparkSession, d: str) -> DataFrame:
    """Numbers in names count as positions only if two files name them."""
    p = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("url", F.lit("[0-9]{2,}"), F.lit(0))).alias("pos")).distinct()
    v = p.groupBy("pos").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("pos")
    return p.join(v, "pos", "left_semi").select("page_id", "pos")


@register("a8_term_frequency", "with t as (select distinct conv_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from conversations) select w, n, row_number() over (order by n desc, w) as rank from (select w, count(*) as n from t group by 1) qualify rank <= 40")
def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").select("conv_id", F.explode(T.tokens(F.col("text"))).alias("w")).distinct().groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return t.orderBy(F.desc("n"), "w").limit(40).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "w")))


@register("a16_corpus_counters", "select lang, source, count(*) as n, sum(n_chars)::bigint as chars from documents group by cube (lang, source)")
def corpus_counters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").cube("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@register("w2_latest_turn", "select conv_id, max(turn) as turn, arg_max(role, turn) as role from conversations group by 1")
def latest_turn(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn"), F.max_by("role", "turn")).toDF("conv_id", "turn", "role")


@register("w8_representative", "select source, arg_min(doc_id, -n_chars * 1000000000 + doc_id) as representative from documents group by 1")
def representative(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.min_by("doc_id", F.struct(-F.col("n_chars"), "doc_id")).alias("representative"))


@register("f6_department_names", "select distinct trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' & ' || p_brand), '&', ' and ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) as department from part")
def departments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(P.department(F.concat_ws(" & ", "p_name", "p_brand")).alias("department")).distinct()


@register("f7_token_bag", "select conv_id, array_to_string(list_sort(list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z0-9]+'))))), ' ') as bag from conversations where role = 'user' group by 1")
def token_bag(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.flatten(F.collect_list(T.tokens(F.col("text")))).alias("t"))
    return c.select("conv_id", F.array_join(F.array_sort(F.array_distinct("t")), " ").alias("bag"))


@register("f9_retruncated", "with recursive l as (select doc_id, string_split(text, chr(10)) as l from documents), c as (select doc_id, i, sum(length(l[i]) + 1) over (partition by doc_id order by i) as n, l[i] as x from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from l)) select d.doc_id, coalesce(length(string_agg(c.x, chr(10) order by c.i)), 0) as n from documents d left join c on c.doc_id = d.doc_id and c.n <= 601 group by 1")
def retruncated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.length(P.retruncated(F.col("text"), 600)).cast("long").alias("n"))


@register("f10_flattened", "select conv_id, sha256(string_agg(role || ': ' || text, chr(10) order by turn)) as h from conversations group by 1")
def flattened(spark: SparkSession, d: str) -> DataFrame:
    r = F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("s"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(r, lambda x: x["s"]), "\n"), 256).alias("h"))


@register("f11_evidence_window", "with a as (select doc_id, text, instr(lower(text), 'licensed under') as pos from documents where contains(lower(text), 'licensed under')), s as (select *, greatest(1, pos - 20) as start from a), z as (select *, pos + 14 + 20 - start as size from s) select doc_id, (case when start > 1 then '…' else '' end) || substring(text, start::int, size::int) || (case when start + size - 1 < length(text) then '…' else '' end) as evidence from z")
def evidence_window(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", P.evidence(F.col("text"), "licensed under").alias("evidence")).filter("evidence is not null")


@register("f12_bounded_lists", "select source, (select string_agg(x, ', ' order by x) from (select unnest(list_sort(list(distinct d.lang))[1:2]) as x)) || case when count(distinct d.lang) > 2 then ', …' else '' end as langs from documents d group by source")
def bounded_lists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(P.bounded_list(F.array_sort(F.collect_set("lang")), 2).alias("langs"))


@register("f16_group_evidence", "select doc_id, case when contains(text, 'GNU General Public') then 'gpl' when contains(text, 'Apache License') then 'apache' when contains(text, 'CC BY') then 'cc' end as license from documents")
def group_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The best-ranked evidence wins: the ladder's order is the rank."""
    c = lambda s: F.contains("text", F.lit(s))
    return table(spark, d, "documents").select("doc_id", F.when(c("GNU General Public"), "gpl").when(c("Apache License"), "apache").when(c("CC BY"), "cc").alias("license"))


@register("f17_versions_in_text", r"select doc_id, try_cast(nullif(regexp_extract(text, '(?:License, Version|License, version|BY-NC) ([0-9]+(\.[0-9]+)?)', 1), '') as double) as version from documents")
def versions_in_text(spark: SparkSession, d: str) -> DataFrame:
    v = F.regexp_extract("text", r"(?:License, Version|License, version|BY-NC) ([0-9]+(\.[0-9]+)?)", 1)
    return table(spark, d, "documents").select("doc_id", F.nullif(v, F.lit("")).try_cast("double").alias("version"))


@register("f19_parse_confidence", "select page_id, round(((case when contains(html, '<h1') and contains(html, '</h1>') then 0.9 when contains(html, '<h1') then 0.4 else 0.0 end) + (case when contains(html, '<nav') and contains(html, '<ul') then 0.9 when contains(html, '<nav') then 0.4 else 0.0 end) + (case when contains(html, '<table') and contains(html, '<tr') then 0.9 when contains(html, '<table') then 0.4 else 0.0 end)) / 3, 4) as confidence from pages")
def parse_confidence(spark: SparkSession, d: str) -> DataFrame:
    c = lambda s: F.contains("html", F.lit(s))
    parts = [P.section_confidence(c(a), c(b)) for a, b in (("<h1", "</h1>"), ("<nav", "<ul"), ("<table", "<tr"))]
    return table(spark, d, "pages").select("page_id", P.parse_confidence(parts).alias("confidence"))


NAME_SQL = "strftime(o_orderdate, '%Y%m%d') || '-position-' || o_orderkey"


@register("f20_name_facets", f"select o_orderkey, try_strptime(regexp_extract(n, '^([0-9]{{8}})', 1), '%Y%m%d')::date as dated, case when year(o_orderdate) >= 2023 then 'current' when year(o_orderdate) >= 2018 then 'new' when year(o_orderdate) >= 2009 then 'mid' else 'old' end as era, lpad(regexp_extract(n, 'position-([0-9]+)', 1), 8, '0') as position from (select *, {NAME_SQL} as n from orders)")
def name_facets(spark: SparkSession, d: str) -> DataFrame:
    n = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-position-"), F.col("o_orderkey").cast("string"))
    o = table(spark, d, "orders").select("o_orderkey", n.alias("n")).withColumn("dated", P.date_prefix(F.col("n")))
    return o.select("o_orderkey", "dated", P.era(F.col("dated")).alias("era"), F.lpad(F.regexp_extract("n", "position-([0-9]+)", 1), 8, "0").alias("position"))


@register("f22_field_probe", "with l as (select doc_id, i, string_split(text, chr(10))[i] as l from (select doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)) select doc_id, count(*) filter (where contains(l, 'token = ')) as labels, count(*) filter (where regexp_matches(l, 'token = \"[0-9a-f]+\"')) as readable from l group by 1")
def field_probe(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return lines.groupBy("doc_id").agg(F.count_if(F.contains("l", F.lit("token = "))).alias("labels"), F.count_if(F.col("l").rlike('token = "[0-9a-f]+"')).alias("readable"))


@register("f25_messages", "select doc_id, 'Document ' || doc_id || ' has ' || n_chars || ' characters in ' || lang as message from documents")
def messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", P.message("Document {id} has {n} characters in {lang}", id=F.col("doc_id"), n=F.col("n_chars"), lang=F.col("lang")).alias("message"))


YEARS_SQL = "case p_partkey % 4 when 0 then p_size || ' years of work' when 1 then 'three years, then 5 years' when 2 then 'at least 7+ years or ten years' else 'no amount' end"


@register("m14_years_in_text", "select p_partkey, case p_partkey % 4 when 0 then p_size when 1 then 3 when 2 then 7 end as years from part")
def years_in_text(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    t = F.when(k == 0, F.concat(F.col("p_size").cast("string"), F.lit(" years of work"))).when(k == 1, "three years, then 5 years").when(k == 2, "at least 7+ years or ten years").otherwise("no amount")
    return table(spark, d, "part").select("p_partkey", P.years(t).alias("years"))


@register("m15_factor_levels", "select doc_id, points, case when points >= 4 then 'high' when points >= 2 then 'middle' else 'low' end as level from (select doc_id, least(5, (contains(text, 'token'))::int * 2 + (contains(text, 'icense'))::int * 2 + (n_chars > 2000)::int + (contains(text, '@'))::int) as points from documents)")
def factor_levels(spark: SparkSession, d: str) -> DataFrame:
    c = lambda s: F.contains("text", F.lit(s)).cast("int")
    p = F.least(F.lit(5), c("token") * 2 + c("icense") * 2 + (F.col("n_chars") > 2000).cast("int") + c("@"))
    return table(spark, d, "documents").select("doc_id", p.alias("points")).withColumn("level", P.level(F.col("points"), ((4, "high"), (2, "middle")), "low"))


@register("m16_term_density", "select doc_id, " + " + ".join(f"regexp_matches(lower(text), '(^|[^a-z]){t}([^a-z]|$)')::int" for t in ("the", "und", "les", "los", "token")) + " as density from documents")
def term_density(spark: SparkSession, d: str) -> DataFrame:
    terms = F.array(*[F.lit(f"(^|[^a-z]){t}([^a-z]|$)") for t in ("the", "und", "les", "los", "token")])
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(terms, lambda t: F.regexp_like(F.lower("text"), t))).alias("density"))


@register("x5_array_containment", "select conv_id from (select conv_id, list(distinct role) as r from conversations group by 1) where list_contains(r, 'system')")
def array_containment(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("r")).filter(F.exists("r", lambda x: x == "system")).select("conv_id")


@register("c15_embedding_pass")
def embedding_pass(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of distinct texts that have none yet; the encoder is a callable, so SQL has no form of it."""
    docs = table(spark, d, "documents")
    present = docs.filter("doc_id % 3 = 0").select(F.sha2("text", 256).alias("sha256"), F.lit("v1").alias("stamp")).distinct()
    return V.encoded(V.pending(docs, present, "v1"), V.hashed_encoder(), "v1").select("sha256", "stamp", F.size("vector").alias("dim"), "used")


@register("c17_clone_sources", f"with t as (select p_partkey, {TITLE_SQL} as title from part), p0 as (select p_partkey, 0 as p from t where lower(title) = 'plumber'), p1 as (select p_partkey, 1 as p from t where starts_with(lower(title), 'program')), p2 as (select p_partkey, 2 as p from part where p_brand = 'Brand#3'), u as (select * from p0 union all select * from p1 union all select * from p2) select p_partkey, min(p) as pass_no from u group by 1")
def clone_sources(spark: SparkSession, d: str) -> DataFrame:
    t = titles(spark, d)
    passes = [t.filter(F.lower("title") == "plumber"), t.filter(F.startswith(F.lower("title"), F.lit("program"))), t.filter("p_brand = 'Brand#3'")]
    return R.merged_passes([p.select("p_partkey", F.col("p_partkey").alias("rank")) for p in passes], "p_partkey").select("p_partkey", "pass_no")


@register("c22_role_detail", "with m as (select o_custkey, count(*) as members, max(o_orderkey) as last from orders group by 1) select c_custkey, c_name, coalesce(members, 0) as members, last from customer left join m on o_custkey = c_custkey")
def role_detail(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("members"), F.max("o_orderkey").alias("last"))
    return table(spark, d, "customer").join(m, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("members", F.lit(0)).alias("members"), "last")


@register("c26_anti_fabrication", "with t as (select conv_id, turn, role, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as t from conversations), s as (select conv_id, list_distinct(flatten(list(t))) as v from t where role <> 'assistant' group by 1) select t.conv_id, t.turn, len(t.t) = 0 or len(list_intersect(t.t, coalesce(s.v, []))) >= 0.5 * len(t.t) as grounded from t left join s using (conv_id) where role = 'assistant'")
def anti_fabrication(spark: SparkSession, d: str) -> DataFrame:
    """Whether half of an answer's words are words that its conversation gave."""
    t = table(spark, d, "conversations").select("conv_id", "turn", "role", F.array_distinct(T.tokens(F.col("text"))).alias("t"))
    s = t.filter("role <> 'assistant'").groupBy("conv_id").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("v"))
    none = F.array().cast("array<string>")
    a = t.filter("role = 'assistant'").join(s, "conv_id", "left").withColumn("v", F.coalesce("v", none))
    return a.select("conv_id", "turn", ((F.size("t") == 0) | (F.size(F.array_intersect("t", "v")) >= 0.5 * F.size("t"))).alias("grounded"))


@register("g1_similar_artifacts", "select vec_id, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 7)), 4) as score from embeddings where vec_id <> 7 order by list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 7)) desc, vec_id limit 5")
def similar_artifacts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id = 7").select("embedding").first()[0]
    return R.top_k_cosine(e.filter("vec_id <> 7"), q, 5).withColumn("score", F.round("score", 4))


@register("z1_daily_increments", "select date_trunc('day', ts)::date as day, count(*) as n, sum(count(*)) over (order by date_trunc('day', ts)::date)::bigint as upto from events group by 1")
def daily_increments(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("upto", F.sum("n").over(Window.orderBy("day")))
