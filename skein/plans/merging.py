"""Merging clusters, diffs, the audit log and streams: ``conversations`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import numbers as N
from skein.functions import text as T
from skein.operators import graph as G
from skein.operators import merge as M
from skein.operators import ranking as R
from skein.sources.tables import table
from skein.streaming import events as Z

from .registry import register


@register("merge_modal_fields", "with n as (select conv_id, role, count(*) as n from conversations group by 1, 2), r as (select *, row_number() over (partition by conv_id order by n desc, role) as r, count(*) over (partition by conv_id) as k from n) select conv_id, role, n, k > 1 as disagree from r where r = 1")
def merge_modal(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    k = c.groupBy("conv_id").agg((F.countDistinct("role") > 1).alias("disagree"))
    return G.modal(c, ["conv_id"], "role").join(k, "conv_id")


@register("merge_central_summary", "with t as (select conv_id, turn, text, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as t from conversations), p as (select x.conv_id, x.turn, x.text, sum(case when len(list_distinct(list_concat(x.t, y.t))) = 0 then 1.0 else len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))) end) as s from t x join t y on x.conv_id = y.conv_id and x.turn <> y.turn group by 1, 2, 3) select conv_id, turn, round(s, 6) as centrality from (select *, row_number() over (partition by conv_id order by round(s, 6) desc, length(text), text, turn) as r from p) where r = 1")
def central_summary(spark: SparkSession, d: str) -> DataFrame:
    """The member most like the others of its cluster; clusters are of bounded size (see the rule on oversize)."""
    t = table(spark, d, "conversations").select("conv_id", "turn", "text", F.array_distinct(T.tokens(F.col("text"))).alias("t"))
    o = t.select("conv_id", F.col("turn").alias("u"), F.col("t").alias("w"))
    s = t.join(o, "conv_id").filter("turn <> u").groupBy("conv_id", "turn", "text").agg(F.round(F.sum(T.jaccard(F.col("t"), F.col("w"), 1.0)), 6).alias("centrality"))
    return R.latest(s, ["conv_id"], F.desc("centrality"), F.asc(F.length("text")), F.asc("text"), F.asc("turn")).select("conv_id", "turn", "centrality")


@register("merge_union_statements")
def union_statements(spark: SparkSession, d: str) -> DataFrame:
    """Greedy grouping against each group's seed depends on the order, so SQL has no form of it."""
    lines = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("statement")).filter("trim(statement) <> ''")
    return M.grouped_statements(lines, "conv_id", "turn", "statement")


@register("merge_core_tokens", "with t as (select distinct conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from conversations), m as (select conv_id, count(*) as n from conversations group by 1) select conv_id, count(*) as core from (select conv_id, w, count(*) as k from t group by 1, 2) join m using (conv_id) where k >= 0.5 * n group by 1")
def core_tokens(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    n = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    k = c.select("conv_id", "turn", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("w")).groupBy("conv_id", "w").agg(F.count(F.lit(1)).alias("k"))
    return k.join(n, "conv_id").filter("k >= 0.5 * n").groupBy("conv_id").agg(F.count(F.lit(1)).alias("core"))


@register("c9_change_log", "with m as (select conv_id, lower(trim(text)) as s, min(turn) as first, count(*) as n from conversations group by 1, 2), r as (select *, row_number() over (partition by conv_id order by first) as place from m) select c.conv_id, c.turn, case when c.turn <> r.first then 'dedup' when r.place > 4 then 'cap_dropped' else 'kept' end as change from conversations c join r on c.conv_id = r.conv_id and lower(trim(c.text)) = r.s")
def change_log(spark: SparkSession, d: str) -> DataFrame:
    """Why each member's statement is or isn't in the merged record."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.lower(F.trim("text")).alias("s"))
    m = c.groupBy("conv_id", "s").agg(F.min("turn").alias("first"))
    r = m.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("first")))
    change = F.when(F.col("turn") != F.col("first"), "dedup").when(F.col("place") > 4, "cap_dropped").otherwise("kept")
    return c.join(r, ["conv_id", "s"]).select("conv_id", "turn", change.alias("change"))


@register("f24_version_diff", "select x.conv_id, x.turn, x.role is distinct from y.role as role_changed, x.text is distinct from y.text as text_changed from conversations x join conversations y on x.conv_id = y.conv_id and y.turn = x.turn + 1")
def version_diff(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("r"), F.col("text").alias("t"))
    return c.join(n, ["conv_id", "turn"]).select("conv_id", "turn", (~F.col("role").eqNullSafe(F.col("r"))).alias("role_changed"), (~F.col("text").eqNullSafe(F.col("t"))).alias("text_changed"))


@register("f24_word_diff")
def word_diff(spark: SparkSession, d: str) -> DataFrame:
    """Spans of words kept, gone and new between a member and the next one; tests check it by rebuilding both."""
    c = table(spark, d, "conversations")
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    return M.word_diffs(c.select("conv_id", "turn", F.col("text").alias("before")).join(n, ["conv_id", "turn"]), ["conv_id", "turn"])


@register("w10_order_check", "with p as (select conv_id, turn, case role when 'system' then 0 when 'user' then 1 else 2 end as k from conversations), l as (select conv_id, k, lag(k) over (partition by conv_id order by turn) as b from p) select conv_id, not coalesce(bool_or(b > k), false) as ordered from l group by 1")
def order_check(spark: SparkSession, d: str) -> DataFrame:
    k = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    p = table(spark, d, "conversations").select("conv_id", "turn", k.alias("k")).withColumn("b", F.lag("k").over(Window.partitionBy("conv_id").orderBy("turn")))
    return p.groupBy("conv_id").agg((~F.coalesce(F.bool_or(F.col("b") > F.col("k")), F.lit(False))).alias("ordered"))


@register("w11_runs", "with x as (select user_id, event_id, event_type, case when lag(event_type) over (partition by user_id order by event_id) = event_type then 0 else 1 end as n from events), y as (select *, sum(n) over (partition by user_id order by event_id) as run from x) select user_id, run::bigint as run, min(event_type) as value, min(event_id) as first, max(event_id) as last, count(*) as n from y group by 1, 2")
def type_runs(spark: SparkSession, d: str) -> DataFrame:
    return R.runs(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")


PAYLOAD = "(strftime(ts, '%Y-%m-%d %H:%M:%S') || '|' || coalesce(event_type, '') || '|' || coalesce(event_id::varchar, ''))"


CHAIN = f"with recursive e as (select user_id, event_id, {PAYLOAD} as p, row_number() over (partition by user_id order by event_id) as i from events), c as (select user_id, event_id, i, FIRST as h from e where i = 1 union all select e.user_id, e.event_id, e.i, NEXT as h from c join e on e.user_id = c.user_id and e.i = c.i + 1) select user_id, event_id, h as row_hash from c"


@register("audit_chain", CHAIN.replace("FIRST", "sha256('\\x00'::blob || encode(p))").replace("NEXT", "sha256(unhex(c.h) || encode(e.p))"))
def audit_chain(spark: SparkSession, d: str) -> DataFrame:
    """Hash chains by user, over the raw bytes of the hash before."""
    e = table(spark, d, "events")
    payload = F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.coalesce("event_type", F.lit("")), F.col("event_id").cast("string"))
    return R.hash_chain(e, ["user_id"], ["event_id"], payload)


@register("a9_hex_chain", CHAIN.replace("FIRST", "sha256('00' || p)").replace("NEXT", "sha256(c.h || e.p)"))
def hex_chain(spark: SparkSession, d: str) -> DataFrame:
    """The same fold over hexadecimal text."""
    e = table(spark, d, "events")
    payload = F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.coalesce("event_type", F.lit("")), F.col("event_id").cast("string"))
    return R.hash_chain(e, ["user_id"], ["event_id"], payload, raw=False)


@register("events_json", "select event_type, count(*) as n, sum((props->>'$.k')::bigint)::bigint as k_sum, count(distinct props->>'$.k') as k_distinct from events group by 1")
def events_json(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k.cast("long")).alias("k_sum"), F.countDistinct(k).alias("k_distinct"))


@register("x3_resume_cutoff", "select count(*) as n from events where ts >= timestamp '2024-01-15 00:00:00'")
def resume_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter(F.col("ts") >= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).agg(F.count(F.lit(1)).alias("n"))


@register("events_tumbling", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return Z.tumbling(table(spark, d, "events"), "1 hour").withColumn("total", F.round("total", 4))


@register("events_session", "with x as (select user_id, ts, value, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hour then 0 else 1 end as n from events), y as (select *, sum(n) over (partition by user_id order by ts rows unbounded preceding) as s from x) select user_id, min(ts) as start, count(*) as n from y group by user_id, s")
def events_session(spark: SparkSession, d: str) -> DataFrame:
    return Z.sessions(table(spark, d, "events"), "2 hours")


@register("a18_turn_lengths", "select role, count(*) as n, round(avg(length(text)), 2) as mean, round(median(length(text)), 2) as median from conversations group by 1")
def turn_lengths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("text")), 2).alias("mean"), F.round(F.percentile(F.length("text"), 0.5), 2).alias("median"))


@register("a26_threshold_sweep", "select t.t as threshold, count(*) filter (where s >= t.t) as pairs from (select len(list_intersect(x.t, y.t)) / nullif(len(list_distinct(list_concat(x.t, y.t))), 0) as s from (select conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as t from conversations) x join (select conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as t from conversations) y on x.conv_id = y.conv_id and x.turn < y.turn), (values (0.1), (0.3), (0.5), (0.7)) t(t) group by 1")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs of a cluster's members pass each threshold: one pass over the pairs, the thresholds as an array."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(T.tokens(F.col("text"))).alias("t"))
    o = t.select("conv_id", F.col("turn").alias("u"), F.col("t").alias("w"))
    s = t.join(o, "conv_id").filter("turn < u").select(T.jaccard(F.col("t"), F.col("w")).alias("s"))
    each = s.select("s", F.explode(F.array(*[F.lit(x).cast("decimal(2,1)") for x in (0.1, 0.3, 0.5, 0.7)])).alias("threshold"))
    return each.groupBy("threshold").agg(F.count_if(F.col("s") >= F.col("threshold").cast("double")).alias("pairs"))


@register("m_seniority", "select c_custkey, round(case when c_acctbal is null or s_acctbal is null then 0.7 else greatest(0.0, 1 - abs(c_acctbal - s_acctbal) / 10000.0) end, 6) as closeness from customer join supplier on s_suppkey = c_custkey % 10")
def seniority(spark: SparkSession, d: str) -> DataFrame:
    from skein.config import CompareConfig

    s = table(spark, d, "supplier").select((F.col("s_suppkey")).alias("k"), "s_acctbal")
    j = table(spark, d, "customer").join(s, F.col("c_custkey") % 10 == F.col("k"))
    return j.select("c_custkey", F.round(N.closeness(F.col("c_acctbal"), F.col("s_acctbal"), CompareConfig(span_years=10000.0)), 6).alias("closeness"))
