"""Duplicates, near-duplicates, clusters and reconciling, over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.config import DedupConfig
from skein.functions import text as T
from skein.operators import edges as E
from skein.operators import graph as G
from skein.operators import ranking as R
from skein.sources.tables import table

from .registry import register

# ---- SQL parts that several statements share ------------------------------------------------------
SHA = "h as (select doc_id, source, lang, n_chars, text, sha256(coalesce(text, '')) as sha from documents)"
GROUPS = f"{SHA}, g as (select sha, min(doc_id) as rep, count(*) as n from h group by sha)"
GRAMS = (
    GROUPS
    + """, tok as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as t from documents where doc_id in (select rep from g)),
 gr as (select distinct doc_id, array_to_string(t[i:i+4], ' ') as gram from (select doc_id, t, unnest(range(1, len(t) - 3)) as i from tok where len(t) >= 5)),
 sz as (select doc_id, count(*) as n from gr group by doc_id having count(*) >= 20),
 big as (select gr.doc_id, gram, sz.n from gr join sz on gr.doc_id = sz.doc_id),
 ov as (select x.doc_id as a, y.doc_id as b, any_value(x.n) as na, any_value(y.n) as nb, count(*) as c from big x join big y on x.gram = y.gram and x.doc_id < y.doc_id group by 1, 2),
 pairs as (select a, b, c / (na + nb - c) as score from ov)"""
)
NEAR = DedupConfig()


@register("a1_exact_groups", f"with {GROUPS} select rep, n from g where n >= 2")
def exact_groups(spark: SparkSession, d: str) -> DataFrame:
    return E.exact_groups(table(spark, d, "documents")).select("rep", "n")


@register("exact_dup_star_edges", f"with {GROUPS} select rep as a, doc_id as b, 'exact' as tier, 1.0::double as score, 'sha256' as method from h join g using (sha) where doc_id <> rep")
def exact_star(spark: SparkSession, d: str) -> DataFrame:
    return E.exact_star(table(spark, d, "documents"))


@register("exact_dup_clique_edges", f"with {SHA} select x.doc_id as a, y.doc_id as b, 'exact' as tier, 1.0::double as score, 'sha256' as method from h x join h y on x.sha = y.sha and x.doc_id < y.doc_id")
def exact_clique(spark: SparkSession, d: str) -> DataFrame:
    return E.exact_clique(table(spark, d, "documents"), 10_000_000)


@register("a3_edge_costs", f"with {GROUPS} select sum(n - 1)::bigint as star_edges, sum(n * (n - 1) // 2)::bigint as clique_edges from g where n >= 2")
def edge_costs(spark: SparkSession, d: str) -> DataFrame:
    return E.edge_costs(table(spark, d, "documents"))


@register(
    "dup_report",
    f"""with {GROUPS} select sum(n)::bigint as files, count(*) as distinct_contents, count(*) filter (where n > 1) as groups,
 sum(case when n > 1 then n else 0 end)::bigint as grouped_files, sum(n - 1)::bigint as redundant, round(sum(n - 1) / sum(n), 6) as redundant_share, max(n) as largest from g""",
)
def dup_report(spark: SparkSession, d: str) -> DataFrame:
    return E.duplicate_report(table(spark, d, "documents"))


@register("dup_size_histogram", f"with {GROUPS} select n as size, count(*) as groups from g where n >= 2 group by n")
def dup_sizes(spark: SparkSession, d: str) -> DataFrame:
    return E.exact_groups(table(spark, d, "documents")).groupBy(F.col("n").alias("size")).agg(F.count(F.lit(1)).alias("groups"))


@register("dup_spanning_sources", f"with {SHA} select sources > 1 as spanning, count(*) as groups from (select sha, count(*) as n, count(distinct source) as sources from h group by sha having count(*) >= 2) group by 1")
def dup_spanning(spark: SparkSession, d: str) -> DataFrame:
    g = E.with_hash(table(spark, d, "documents")).groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))
    return g.filter("n >= 2").groupBy((F.col("sources") > 1).alias("spanning")).agg(F.count(F.lit(1)).alias("groups"))


@register("w4_first_per_content", f"with {GROUPS} select rep as doc_id from g")
def first_per_content(spark: SparkSession, d: str) -> DataFrame:
    return E.exact_groups(table(spark, d, "documents"), 1).select(F.col("rep").alias("doc_id"))


@register(
    "w9_hub_anchor",
    f"""with {GROUPS}, e as (select sha as grp, rep as a, doc_id as b from h join g using (sha) where doc_id <> rep), ends as (select grp, a as v from e union all select grp, b from e),
 dg as (select grp, v, count(*) as d from ends group by 1, 2), sz as (select grp, count(*) as e from e group by 1)
 select grp, arg_min(v, (case when d = e then 0 else 1000000000000 end) + v) as anchor from dg join sz using (grp) group by grp""",
)
def hub_anchor(spark: SparkSession, d: str) -> DataFrame:
    docs = E.with_hash(table(spark, d, "documents"))
    star = E.exact_star(table(spark, d, "documents")).select("a", "b")
    return E.hub_anchor(star.join(docs.select(F.col("doc_id").alias("a"), F.col("sha256").alias("grp")), "a"))


@register("shingle_counts", "with tok as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as t from documents), gr as (select distinct doc_id, array_to_string(t[i:i+4], ' ') as gram from (select doc_id, t, unnest(range(1, len(t) - 3)) as i from tok where len(t) >= 5)) select d.doc_id, coalesce(n, 0) as n_grams, coalesce(n, 0) < 20 as below_min from documents d left join (select doc_id, count(*) as n from gr group by 1) using (doc_id)")
def shingle_counts(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(T.shingles(T.tokens(F.col("text")), NEAR.shingle)).cast("long")
    return table(spark, d, "documents").select("doc_id", n.alias("n_grams")).withColumn("below_min", F.col("n_grams") < NEAR.min_shingles)


def near_pairs(spark: SparkSession, d: str) -> DataFrame:
    return E.near_pairs(table(spark, d, "documents"), NEAR)


@register("near_dup_pairs", f"with {GRAMS} select a, b, round(score, 6) as score from pairs where score >= 0.85")
def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return near_pairs(spark, d).withColumn("score", F.round("score", 6))


@register(
    "near_dup_file_scope",
    f"with {GRAMS} select least(x.doc_id, y.doc_id) as a, greatest(x.doc_id, y.doc_id) as b, round(score, 6) as score from pairs p join g ga on p.a = ga.rep join g gb on p.b = gb.rep join h x on x.sha = ga.sha join h y on y.sha = gb.sha where score >= 0.85",
)
def near_dup_file_scope(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    member = E.with_hash(docs).select("doc_id", "sha256").join(E.exact_groups(docs, 1), "sha256").select("doc_id", "rep")
    x, y = member.select(F.col("doc_id").alias("x"), F.col("rep").alias("a")), member.select(F.col("doc_id").alias("y"), F.col("rep").alias("b"))
    return near_pairs(spark, d).join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.round("score", 6).alias("score"))


@register(
    "near_dup_percentiles",
    f"with {GRAMS}, s as (select score, row_number() over (order by score) - 1 as i, count(*) over () as n from pairs where score >= 0.85) select coalesce(max(n), 0)::bigint as n, "
    + ", ".join(f"round(min(case when i = least(n - 1, floor(n * {p} / 100)) then score end), 6) as p{p}" for p in (10, 50, 90, 99))
    + ", round(max(score), 6) as max from s",
)
def near_dup_percentiles(spark: SparkSession, d: str) -> DataFrame:
    out = E.percentiles(near_pairs(spark, d), "score")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p90", "p99", "max")])


STRATA = """, e as (select a, b, round(score, 6) as score, (score >= 0.95) as high, (x.source = y.source) as same_source from pairs join documents x on a = x.doc_id join documents y on b = y.doc_id where score >= 0.85),
 r as (select *, row_number() over (partition by high, same_source order by a, b) - 1 as i, count(*) over (partition by high, same_source) as n from e)
 select a, b, score, high, same_source from r where i % greatest(1, n // 10) = 0 and i // greatest(1, n // 10) < 10"""


@register("near_dup_strata_sample", f"with {GRAMS}{STRATA}")
def near_dup_strata(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "documents").select("doc_id", "source")
    e = near_pairs(spark, d).join(src.select(F.col("doc_id").alias("a"), F.col("source").alias("sa")), "a").join(src.select(F.col("doc_id").alias("b"), F.col("source").alias("sb")), "b")
    e = e.select("a", "b", F.round("score", 6).alias("score"), (F.col("score") >= 0.95).alias("high"), (F.col("sa") == F.col("sb")).alias("same_source"))
    return E.strata_sample(e, ["high", "same_source"], 10, "a", "b")


@register("minhash_lsh_candidates")
def minhash_lsh(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by a hash family that SQL hasn't; tests hold them against the exact pairs."""
    return E.lsh_candidates(table(spark, d, "documents"), NEAR, most=5_000_000)


CC = f"""with recursive {GRAMS}, e as (select a, b from pairs where score >= 0.85 union select rep, doc_id from h join g using (sha) where doc_id <> rep),
 s as (select a as u, b as v from e union select b, a from e),
 walk as (select u as v, u as c from s union select s.v, walk.c from walk join s on s.u = walk.v),
 lab as (select v, min(c) as c from walk group by v)"""


def all_edges(spark: SparkSession, d: str) -> DataFrame:
    return near_pairs(spark, d).select("a", "b").unionByName(E.exact_star(table(spark, d, "documents")).select("a", "b"))


@register("dup_clusters", f"{CC} select v as doc_id, c as cluster_id from lab")
def dup_clusters(spark: SparkSession, d: str) -> DataFrame:
    return G.components(all_edges(spark, d)).select(F.col("v").alias("doc_id"), F.col("c").alias("cluster_id"))


@register(
    "cluster_metrics",
    f"""{CC} select c as cluster_id, count(*) as size, count(distinct source) as sources, count(distinct lang) as langs, arg_min(v, -n_chars * 1000000000 + v) as representative, count(distinct lang) > 1 as mixed, count(*) > 50 as oversize
 from lab join documents on v = doc_id group by c""",
)
def cluster_metrics(spark: SparkSession, d: str) -> DataFrame:
    member = G.components(all_edges(spark, d)).join(table(spark, d, "documents"), F.col("v") == F.col("doc_id"))
    return member.groupBy(F.col("c").alias("cluster_id")).agg(
        F.count(F.lit(1)).alias("size"),
        F.countDistinct("source").alias("sources"),
        F.countDistinct("lang").alias("langs"),
        F.min(F.struct((-F.col("n_chars")).alias("k"), F.col("v"))).getField("v").alias("representative"),
        (F.countDistinct("lang") > 1).alias("mixed"),
        (F.count(F.lit(1)) > 50).alias("oversize"),
    )


@register("j14_cluster_edges", f"{CC} select e.a, e.b, la.c as cluster_id from e join lab la on e.a = la.v join lab lb on e.b = lb.v where la.c = lb.c")
def cluster_edges(spark: SparkSession, d: str) -> DataFrame:
    e = G.checkpointed(all_edges(spark, d).distinct())
    return G.attributed(e, G.components(e)).withColumnRenamed("c", "cluster_id")


@register(
    "a13_cluster_label",
    f"{CC} select cluster_id, source as label, n from (select c as cluster_id, source, count(*) as n, row_number() over (partition by c order by count(*) desc, length(source), source) as r from lab join documents on v = doc_id group by 1, 2) where r = 1",
)
def cluster_label(spark: SparkSession, d: str) -> DataFrame:
    member = G.components(all_edges(spark, d)).join(table(spark, d, "documents"), F.col("v") == F.col("doc_id")).withColumnRenamed("c", "cluster_id")
    return G.modal(member, ["cluster_id"], "source", F.asc(F.length("source"))).withColumnRenamed("source", "label")


ADMIT = """select coalesce(drop_reason, 'admitted') as outcome, count(*) as n from (select case when score < 0.9 then 'below_role_min' when abs(length(x.lang) - length(y.lang)) > 1 then 'band_veto' when x.lang <> y.lang then 'group_veto' end as drop_reason
 from pairs join documents x on a = x.doc_id join documents y on b = y.doc_id where score >= 0.5) group by 1"""


@register("edge_admission", f"with {GRAMS} {ADMIT}")
def edge_admission(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    lang = docs.select("doc_id", "lang")
    pairs = E.near_pairs(docs, DedupConfig(jaccard=0.5))
    e = pairs.join(lang.select(F.col("doc_id").alias("a"), F.col("lang").alias("la")), "a").join(lang.select(F.col("doc_id").alias("b"), F.col("lang").alias("lb")), "b")
    reasons = [("below_role_min", F.col("score") < 0.9), ("band_veto", F.abs(F.length("la") - F.length("lb")) > 1), ("group_veto", F.col("la") != F.col("lb"))]
    return E.admitted(e, reasons).groupBy(F.coalesce("drop_reason", F.lit("admitted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "edge_reconcile",
    f"""with {GRAMS}, plan as (select a, b, round(score, 4) as score, 'v2' as method from pairs where score >= 0.85),
 present as (select a, b, round(score, 4) as score, case when a % 3 = 0 then 'v1' else 'v2' end as method from pairs where score >= 0.7 and b % 5 <> 0)
 select case when q.a is null then 'insert' when p.a is null then 'prune' when p.score = q.score and p.method = q.method then 'unchanged' else 'update' end as action, count(*) as n
 from plan p full outer join present q on p.a = q.a and p.b = q.b group by 1""",
)
def edge_reconcile(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    wide = G.checkpointed(E.near_pairs(docs, DedupConfig(jaccard=0.7)).withColumn("raw", F.col("score")).withColumn("score", F.round("score", 4)))
    plan = wide.filter("raw >= 0.85").select("a", "b", "score", F.lit("v2").alias("method"))
    present = wide.filter("b % 5 <> 0").select("a", "b", "score", F.when(F.col("a") % 3 == 0, "v1").otherwise("v2").alias("method"))
    return E.reconciled(plan, present, docs).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@register("j4_incident_documents", f"with {GRAMS} select doc_id from documents where doc_id in (select a from pairs where score >= 0.85 union select b from pairs where score >= 0.85)")
def incident(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "documents").select(F.col("doc_id").alias("v"))
    return E.incident(nodes, near_pairs(spark, d)).select(F.col("v").alias("doc_id"))


RELATED = f"""with {GRAMS}, e as (select a, b from pairs where score >= 0.5), s as (select a as u, b as v from e union all select b, a from e),
 r as (select x.source, y.source as other, count(distinct y.doc_id) as docs from s join documents x on s.u = x.doc_id join documents y on s.v = y.doc_id where x.source <> y.source group by 1, 2)
 select source, other, docs, rank from (select *, row_number() over (partition by source order by docs desc, other) as rank from r) where rank <= 8"""


@register("related_roles", RELATED)
def related_roles(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    s = E.symmetric(E.near_pairs(docs.sparkSession.read.parquet(f"{d}/documents.parquet"), DedupConfig(jaccard=0.5)))
    joined = s.join(docs.select(F.col("doc_id").alias("u"), "source"), "u").join(docs.select(F.col("doc_id").alias("v"), F.col("source").alias("other")), "v")
    n = joined.filter("source <> other").groupBy("source", "other").agg(F.countDistinct("v").alias("docs"))
    w = R.Window.partitionBy("source").orderBy(F.desc("docs"), F.asc("other"))
    return n.withColumn("rank", F.row_number().over(w)).filter("rank <= 8")


@register("a14_group_disagreement", f"with {SHA} select sha, count(distinct source) > 1 as disagree from h group by sha having count(*) >= 2")
def disagreement(spark: SparkSession, d: str) -> DataFrame:
    g = E.with_hash(table(spark, d, "documents")).groupBy(F.col("sha256").alias("sha")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("s"))
    return g.filter("n >= 2").select("sha", (F.col("s") > 1).alias("disagree"))


@register("s9_new_rows", f"with {GROUPS} select count(*) as inserted from g where rep % 4 <> 0")
def new_rows(spark: SparkSession, d: str) -> DataFrame:
    from skein.sources.tables import new_rows as fresh

    hashed = E.exact_groups(table(spark, d, "documents"), 1)
    return fresh(hashed, hashed.filter("rep % 4 = 0"), ["sha256"]).agg(F.count(F.lit(1)).alias("inserted"))
