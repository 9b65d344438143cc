"""Rules, scores, gates and baselines over ``documents`` and ``labels``; vectors and blended similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import numbers as N
from skein.functions import text as T
from skein.operators import ranking as R
from skein.operators import rulebook as B
from skein.sources.tables import table

from .registry import register

# ---- rules ----------------------------------------------------------------------------------------
WORDS = "len(regexp_extract_all(text, '[^ \\t\\n\\r]+'))"
_CASES = " union all ".join(f"select doc_id, lang, source, n_chars, '{r.rule_id}' as rule_id, '{r.severity}' as severity from documents where {r.sql}" for r in B.RULES)
FINDINGS = f"f as ({_CASES})"
COUNTS = f"{FINDINGS}, s as (select d.doc_id, d.lang, d.source, d.n_chars, count(*) filter (where severity = 'high') as high, count(*) filter (where severity = 'medium') as medium, count(*) filter (where severity = 'low') as low from documents d left join f using (doc_id) group by 1, 2, 3, 4)"
_PEN = lambda c, b: f"{b} * (1 - pow(0.7, {c})) / 0.3"
SCORES = f"{COUNTS}, sc as (select *, greatest(0.0, 100.0 - {_PEN('high', 20.0)} - {_PEN('medium', 10.0)} - {_PEN('low', 5.0)}) as score from s)"
GRADE = "case when score >= 90 then 'A' when score >= 75 then 'B' when score >= 60 then 'C' when score >= 40 then 'D' else 'F' end"
GATES = f"""{SCORES}, b as (select doc_id, gate from (select doc_id, 'BLOCKING:' || rule_id as gate from f where rule_id in ({', '.join(f"'{x}'" for x in B.BLOCKING)})
 union select doc_id, 'SEVERITY-FLOOR' from f where severity = 'high' union select doc_id, 'SCORE-FLOOR' from sc where score < 60 union select doc_id, 'GRADE-FLOOR' from sc where {GRADE} in ('D', 'F')))"""


def findings(spark: SparkSession, d: str) -> DataFrame:
    return B.findings(table(spark, d, "documents"))


def scores(spark: SparkSession, d: str) -> DataFrame:
    return B.scored(table(spark, d, "documents"))


@register("quality_findings", f"with {FINDINGS} select doc_id, rule_id, severity from f")
def quality_findings(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).select("doc_id", "rule_id", "severity")


@register("quality_scores", f"with {SCORES} select doc_id, high, medium, low, round(score, 6) as score, {GRADE} as grade from sc")
def quality_scores(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).select("doc_id", "high", "medium", "low", F.round("score", 6).alias("score"), "grade")


@register("gate_decisions", f"with {GATES} select d.doc_id, coalesce(string_agg(gate, ',' order by gate), '') as blocking, count(gate) = 0 as approved, count(gate) = 0 and bool_or(l.quality = 1) as agrees from documents d left join b using (doc_id) left join labels l using (doc_id) group by 1")
def gate_decisions(spark: SparkSession, d: str) -> DataFrame:
    g = B.gated(scores(spark, d), findings(spark, d))
    lab = table(spark, d, "labels").groupBy("doc_id").agg(F.bool_or(F.col("quality") == 1).alias("good"))
    return g.join(lab, "doc_id", "left").select("doc_id", "blocking", "approved", (F.col("approved") & F.col("good")).alias("agrees"))


@register("gate_frequency", f"with {GATES} select gate, count(*) as n, row_number() over (order by count(*) desc, gate) as rank from b group by 1 qualify rank <= 6")
def gate_frequency(spark: SparkSession, d: str) -> DataFrame:
    each = B.blocked(scores(spark, d), findings(spark, d)).groupBy("gate").agg(F.count(F.lit(1)).alias("n"))
    return each.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.asc("gate")))).filter("rank <= 6")


@register("c12_report_by_rule", f"with {FINDINGS}, r as (select unnest([{', '.join(repr(r.rule_id) for r in B.RULES)}]) as rule_id) select r.rule_id, count(f.doc_id) as findings, count(f.doc_id) = 0 as passed from r left join f using (rule_id) group by 1")
def report_by_rule(spark: SparkSession, d: str) -> DataFrame:
    every = B.catalogue(spark).select("rule_id")
    n = findings(spark, d).groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"))
    return every.join(n, "rule_id", "left").select("rule_id", F.coalesce("findings", F.lit(0)).alias("findings"), F.col("findings").isNull().alias("passed"))


@register("score_histogram", f"with {SCORES}, n as (select least(greatest(floor(score / 10), 0), 9)::int as bin, count(*) as n from sc group by 1) select b.bin::int as bin, coalesce(n.n, 0) as n from range(10) b(bin) left join n using (bin)")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return R.histogram(scores(spark, d), "score", 10.0, 10)


@register("a10_score_statistics", f"with {SCORES} select lang, count(*) as n, round(min(score), 6) as low, round(median(score), 6) as median, round(avg(score), 6) as mean, round(max(score), 6) as high from sc group by 1")
def score_statistics(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(f("score"), 6).alias(a) for f, a in ((F.min, "low"), (lambda c: F.percentile(c, 0.5), "median"), (F.avg, "mean"), (F.max, "high"))]
    )


SEGMENTS = f"""with {SCORES}, h as (select sc.*, sha256(coalesce(text, '')) as sha from sc join documents using (doc_id)), pop as (select 'all' as population, * from h
 union all select 'content_dedup', * exclude (r) from (select *, row_number() over (partition by sha order by doc_id) as r from h) where r = 1
 union all select 'latest_per_source', * exclude (r) from (select *, row_number() over (partition by source order by doc_id desc) as r from h) where r = 1)
 select population, coalesce(lang, '(all)') as lang, coalesce(source, '(all)') as source, count(*) as n, round(avg(score), 6) as mean_score, round(avg(case when score >= 60 then 1.0 else 0.0 end), 6) as passing
 from pop group by grouping sets ((population), (population, lang), (population, source))"""


@register("baseline_segments", SEGMENTS)
def baseline_segments(spark: SparkSession, d: str) -> DataFrame:
    """Three populations by two dimensions in one pass of grouping sets; scores are computed once."""
    h = scores(spark, d).join(table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")), "doc_id").select("doc_id", "lang", "source", "score", "sha")
    first = h.groupBy("sha").agg(F.min_by(F.struct(*h.columns), "doc_id").alias("r")).select("r.*")
    last = h.groupBy("source").agg(F.max_by(F.struct(*h.columns), "doc_id").alias("r")).select("r.*")
    pop = h.withColumn("population", F.lit("all")).unionByName(first.withColumn("population", F.lit("content_dedup"))).unionByName(last.withColumn("population", F.lit("latest_per_source")))
    sets = pop.groupingSets([[F.col("population")], [F.col("population"), F.col("lang")], [F.col("population"), F.col("source")]], "population", "lang", "source")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg(F.when(F.col("score") >= 60, 1.0).otherwise(0.0)), 6).alias("passing")).select(
        "population", F.coalesce("lang", F.lit("(all)")).alias("lang"), F.coalesce("source", F.lit("(all)")).alias("source"), "n", "mean_score", "passing"
    )


@register("a28_outcome_matrix", f"with {FINDINGS}, x as (select d.doc_id, d.lang, max(case when severity = 'high' then 3 when severity = 'medium' then 2 when severity = 'low' then 1 else 0 end) as worst from documents d left join f using (doc_id) group by 1, 2) select lang, count(*) filter (where worst = 0) as clean, count(*) filter (where worst = 1) as low, count(*) filter (where worst = 2) as medium, count(*) filter (where worst = 3) as high from x group by 1")
def outcome_matrix(spark: SparkSession, d: str) -> DataFrame:
    worst = F.when(F.col("high") > 0, "high").when(F.col("medium") > 0, "medium").when(F.col("low") > 0, "low").otherwise("clean")
    out = B.counted(table(spark, d, "documents")).withColumn("worst", worst).groupBy("lang").pivot("worst", ["clean", "low", "medium", "high"]).agg(F.count(F.lit(1)))
    return out.select("lang", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("clean", "low", "medium", "high")])


@register("a30_accounting", f"with {GATES} select (select count(*) from documents) as seen, (select count(distinct doc_id) from b) as blocked, (select count(*) from documents where doc_id not in (select doc_id from b)) as approved")
def accounting(spark: SparkSession, d: str) -> DataFrame:
    g = B.gated(scores(spark, d), findings(spark, d))
    return g.agg(F.count(F.lit(1)).alias("seen"), F.count_if(~F.col("approved")).alias("blocked"), F.count_if("approved").alias("approved"))


# ---- vectors --------------------------------------------------------------------------------------
COS = "list_cosine_similarity({0}::double[], {1}::double[])"


@register("vector_topk", f"with q as (select embedding as e from embeddings where vec_id = 0) select vec_id, round(s, 4) as score from (select vec_id, {COS.format('embedding', 'e')} as s from embeddings, q) order by s desc, vec_id limit 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    query = rows.filter("vec_id = 0").select("embedding").first()[0]
    return R.top_k_cosine(rows, query, 10).withColumn("score", F.round("score", 4))


@register("knn_in_bucket", f"select vec_id, other, round(s, 4) as score, rank from (select x.vec_id, y.vec_id as other, {COS.format('x.embedding', 'y.embedding')} as s, row_number() over (partition by x.vec_id order by {COS.format('x.embedding', 'y.embedding')} desc, y.vec_id) as rank from embeddings x join embeddings y on x.label = y.label and x.vec_id <> y.vec_id) where rank <= 5")
def knn_in_bucket(spark: SparkSession, d: str) -> DataFrame:
    return R.neighbours_in_bucket(table(spark, d, "embeddings"), 5).withColumn("score", F.round("score", 4))


TOK = "tk as (select doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) as t from documents)"
IDF = f"{TOK}, df as (select w, count(*) as df from (select unnest(t) as w from tk) group by 1), idf as (select w, df, greatest(0.0, ln((select count(*) from documents) / (1.0 + df))) as idf from df)"


def document_frequencies(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    n = docs.count()
    df = docs.select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", N.idf(F.lit(n), F.col("df")))


@register("idf_weights", f"with {IDF} select w, df, round(idf, 6) as idf from idf order by df desc, w limit 50")
def idf_weights(spark: SparkSession, d: str) -> DataFrame:
    return document_frequencies(spark, d).orderBy(F.desc("df"), F.asc("w")).limit(50).select("w", "df", F.round("idf", 6).alias("idf"))


@register("skill_overlap_pairs", f"with {IDF}, p as (select doc_id as a, doc_id + 1 as b from documents where doc_id % 2 = 0), x as (select a, b, unnest(t) as w from p join tk on a = doc_id), y as (select a, b, unnest(t) as w from p join tk on b = doc_id), u as (select coalesce(x.a, y.a) as a, coalesce(x.b, y.b) as b, coalesce(x.w, y.w) as w, x.w is not null and y.w is not null as in_both from x full join y on x.a = y.a and x.b = y.b and x.w = y.w) select a, b, round(sum(case when in_both then idf else 0 end) / nullif(sum(idf), 0), 6) as overlap from u join idf using (w) group by 1, 2")
def skill_overlap(spark: SparkSession, d: str) -> DataFrame:
    """idf-weighted overlap of each even document with the next one: words of either, weighted once."""
    tok = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("w"))
    pair = tok.select((F.col("doc_id") - F.col("doc_id") % 2).alias("a"), "w", "doc_id")
    n = pair.groupBy("a", "w").agg(F.count(F.lit(1)).alias("k"))
    both = n.join(document_frequencies(spark, d).select("w", "idf"), "w").groupBy("a").agg(F.sum(F.when(F.col("k") == 2, F.col("idf")).otherwise(0.0)).alias("i"), F.sum("idf").alias("u"))
    return both.select("a", (F.col("a") + 1).alias("b"), F.round(F.col("i") / F.nullif("u", F.lit(0.0)), 6).alias("overlap"))


ROLE = f"""with {IDF}, k as (select x.vec_id as a, y.vec_id as b, {COS.format('x.embedding', 'y.embedding')} as v, row_number() over (partition by x.vec_id order by {COS.format('x.embedding', 'y.embedding')} desc, y.vec_id) as r from embeddings x join embeddings y on x.label = y.label and x.vec_id <> y.vec_id),
 c as (select distinct least(a, b) as a, greatest(a, b) as b from k where r <= 5), cv as (select c.a, c.b, greatest(0.0, least(1.0, {COS.format('x.embedding', 'y.embedding')})) as v from c join embeddings x on c.a = x.vec_id join embeddings y on c.b = y.vec_id),
 xa as (select a, b, unnest(t) as w from cv join tk on a = doc_id), xb as (select a, b, unnest(t) as w from cv join tk on b = doc_id),
 u as (select coalesce(xa.a, xb.a) as a, coalesce(xa.b, xb.b) as b, coalesce(xa.w, xb.w) as w, xa.w is not null and xb.w is not null as in_both from xa full join xb on xa.a = xb.a and xa.b = xb.b and xa.w = xb.w),
 sk as (select a, b, sum(case when in_both then idf else 0 end) / nullif(sum(idf), 0) as s from u join idf using (w) group by 1, 2)
 select cv.a, cv.b, round(least(1.0, greatest(0.0, 0.45 * v + 0.45 * coalesce(s, 0) + 0.10 * (case when x.lang = y.lang then 1.0 else 0.7 end))), 4) as score from cv join documents x on cv.a = x.doc_id join documents y on cv.b = y.doc_id left join sk on cv.a = sk.a and cv.b = sk.b
 where x.source is not distinct from x.source and not (x.lang <> y.lang) and round(least(1.0, greatest(0.0, 0.45 * v + 0.45 * coalesce(s, 0) + 0.10 * (case when x.lang = y.lang then 1.0 else 0.7 end))), 4) >= 0.2"""


@register("role_equivalence_edges", ROLE)
def role_equivalence(spark: SparkSession, d: str) -> DataFrame:
    """Blended score of vectors, weighted words and language of nearest neighbours, those of other languages vetoed."""
    rows, docs = table(spark, d, "embeddings"), table(spark, d, "documents")
    near = R.neighbours_in_bucket(rows, 5).select(F.least("vec_id", "other").alias("a"), F.greatest("vec_id", "other").alias("b"), "score").groupBy("a", "b").agg(F.max("score").alias("v"))
    lang = docs.select("doc_id", "lang")
    pair = near.join(lang.select(F.col("doc_id").alias("a"), F.col("lang").alias("la")), "a").join(lang.select(F.col("doc_id").alias("b"), F.col("lang").alias("lb")), "b").filter(~F.coalesce(F.col("la") != F.col("lb"), F.lit(False)))
    tok = docs.select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("w"))
    ends = pair.select("a", "b", F.explode(F.array("a", "b")).alias("doc_id"))
    idf = document_frequencies(spark, d).select("w", "idf")
    n = ends.join(tok, "doc_id").groupBy("a", "b", "w").agg(F.count(F.lit(1)).alias("k")).join(idf, "w")
    skill = n.groupBy("a", "b").agg((F.sum(F.when(F.col("k") == 2, F.col("idf")).otherwise(0.0)) / F.nullif(F.sum("idf"), F.lit(0.0))).alias("s"))
    score = N.blended(N.clamped(F.col("v")), F.coalesce("s", F.lit(0.0)), F.lit(1.0))
    return pair.join(skill, ["a", "b"], "left").select("a", "b", score.alias("score")).filter("score >= 0.2")


@register("m_clone_verdict", f"with v as (select x.vec_id as a, y.vec_id as b, round({COS.format('x.embedding', 'y.embedding')}, 6) as s from embeddings x join embeddings y on y.vec_id = x.vec_id + 1) select a, b, s, case when s >= 0.92 then 'clone' when s < 0.6 then 'new_job' else 'uncertain' end as verdict from v")
def clone_verdict(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    o = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("embedding").alias("w"))
    s = F.round(N.cosine(F.col("embedding"), F.col("w")), 6)
    return e.join(o, "vec_id").select(F.col("vec_id").alias("a"), "b", s.alias("s")).withColumn("verdict", F.when(F.col("s") >= 0.92, "clone").when(F.col("s") < 0.6, "new_job").otherwise("uncertain"))


@register("drift", f"with {TOK}, p as (select x.doc_id as a, y.doc_id as b, x.t as ta, y.t as tb, x.doc_id as ia, xd.lang as la, yd.lang as lb from tk x join tk y on y.doc_id = x.doc_id + 1 join documents xd on xd.doc_id = x.doc_id join documents yd on yd.doc_id = y.doc_id), q as (select a, b, case when len(list_distinct(list_concat(ta, tb))) = 0 then 0.0 else round(1 - len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))), 4) end as distance, la <> lb as escalated from p) select a, b, distance, case when distance >= 0.5 or escalated then 'major' when distance >= 0.25 then 'minor' else 'aligned' end as level from q")
def drift(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", "lang", F.array_distinct(T.tokens(F.col("text"))).alias("t"))
    o = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("b"), F.col("lang").alias("lb"), F.col("t").alias("u"))
    dist = F.round(1 - T.jaccard(F.col("t"), F.col("u"), both_empty=1.0), 4)
    p = t.join(o, "doc_id").select(F.col("doc_id").alias("a"), "b", dist.alias("distance"), (F.col("lang") != F.col("lb")).alias("e"))
    return p.select("a", "b", "distance", N.drift_level(F.col("distance"), F.col("e")).alias("level"))
