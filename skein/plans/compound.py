"""Composite operators, orders, sources and sinks that other modules lack, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.config import CompareConfig, DedupConfig, MergeConfig
from skein.functions import numbers as N
from skein.functions import text as T
from skein.operators import edges as E
from skein.operators import graph as G
from skein.operators import ranking as R
from skein.operators import redaction as X
from skein.operators import states as St
from skein.session import shared_folder
from skein.sources import tables as S
from skein.sources.tables import table
from skein.streaming import events as Z

from .dedup import GRAMS, GROUPS, SHA
from .quality import COS, IDF, TOK, document_frequencies
from .registry import register
from .text import TITLE_SQL, TRI, titles

# ---- orders and pages -----------------------------------------------------------------------------


@register("o1_oriented_edges", f"with {SHA}, r as (select *, row_number() over (partition by sha order by source, coalesce(lang, ''), doc_id) as r, count(*) over (partition by sha) as n from h) select x.doc_id as a, y.doc_id as b from r x join r y on x.sha = y.sha and x.r = 1 and y.r > 1")
def oriented_edges(spark: SparkSession, d: str) -> DataFrame:
    """Star edges whose first end is the first of its group in the three-part order of documents."""
    docs = E.with_hash(table(spark, d, "documents")).select("sha256", F.struct("source", F.coalesce("lang", F.lit("")).alias("lang"), "doc_id").alias("o"))
    first = docs.groupBy("sha256").agg(F.min("o").alias("f"))
    return docs.join(first, "sha256").filter("o <> f").select(F.col("f.doc_id").alias("a"), F.col("o.doc_id").alias("b"))


@register("o6_cluster_report", f"with {GROUPS}, c as (select sha, min(doc_id) as cluster_id, count(*) as size, count(distinct source) > 1 as mixed from h group by 1 having count(*) > 1) select cluster_id, size, mixed, row_number() over (order by not mixed, size desc, cluster_id) as place from c")
def cluster_report(spark: SparkSession, d: str) -> DataFrame:
    """Clusters that need eyes first: mixed ones, then larger ones."""
    c = E.with_hash(table(spark, d, "documents")).groupBy("sha256").agg(F.min("doc_id").alias("cluster_id"), F.count(F.lit(1)).alias("size"), (F.countDistinct("source") > 1).alias("mixed")).filter("size > 1")
    o = S.numbered(c.withColumn("x", ~F.col("mixed")).withColumn("y", -F.col("size")), "x", "y", "cluster_id")
    return o.select("cluster_id", "size", "mixed", (F.col("_i") + 1).alias("place"))


def page(df: DataFrame, asked: int | None, number: int, *order: str, default: int = 50, most: int = 200) -> DataFrame:
    """A page of an order; the size asked for is held between 1 and ``most``."""
    size = min(max(asked if asked is not None else default, 1), most)
    return df.orderBy(*order).offset(size * max(number, 0)).limit(size)


@register("o8_clamped_pages", "select 'default' as asked, o_orderkey from (select o_orderkey from orders order by o_orderkey limit 50) union all select 'large', o_orderkey from (select o_orderkey from orders order by o_orderkey limit 200 offset 200) union all select 'none', o_orderkey from (select o_orderkey from orders order by o_orderkey limit 1)")
def clamped_pages(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey")
    tag = lambda n, p: p.select(F.lit(n).alias("asked"), "o_orderkey")
    return tag("default", page(o, None, 0, "o_orderkey")).unionByName(tag("large", page(o, 9999, 1, "o_orderkey"))).unionByName(tag("none", page(o, 0, 0, "o_orderkey")))


@register("o9_position_files", r"with p as (select page_id, regexp_extract(url, '//([^/]+)', 1) as host, nullif(regexp_extract(url, '/([0-9]+)', 1), '')::bigint as dated from pages) select host, page_id, row_number() over (partition by host order by dated desc nulls last, page_id) as place from p")
def position_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of each position, newest first and undated last."""
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "//([^/]+)", 1).alias("host"), F.nullif(F.regexp_extract("url", "/([0-9]+)", 1), F.lit("")).cast("long").alias("dated"))
    w = Window.partitionBy("host").orderBy(F.desc_nulls_last("dated"), F.asc("page_id"))
    return p.select("host", "page_id", F.row_number().over(w).alias("place"))


# ---- columns --------------------------------------------------------------------------------------


@register("m6_s_curve", "select b::int as bands, r::int as rows, round(pow(1.0 / b, 1.0 / r), 6) as threshold from range(1, 33) as x(b), range(1, 17) as y(r)")
def s_curve(spark: SparkSession, d: str) -> DataFrame:
    """The similarity at which a pair is about as likely found as not, for sets of bands and rows."""
    sizes = spark.range(1, 33).select(F.col("id").cast("int").alias("bands"), F.explode(F.sequence(F.lit(1), F.lit(16))).alias("rows"))
    return sizes.withColumn("threshold", F.round(F.pow(1.0 / F.col("bands"), 1.0 / F.col("rows")), 6))


@register("m3_estimated_jaccard", None)
def estimated(spark: SparkSession, d: str) -> DataFrame:
    """Estimates from signatures beside exact similarities, for the exact near pairs; a hash family that SQL hasn't."""
    docs = table(spark, d, "documents")
    pairs = E.near_pairs(docs, DedupConfig(jaccard=0.5))
    sig = E.signatures(docs.select("doc_id", T.hashed_shingles(T.tokens(F.col("text")), DedupConfig().shingle).alias("h")).filter(F.size("h") > 0))
    both = pairs.join(sig.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb")), "b")
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    return both.select("a", "b", "score", (same / F.size("sa")).alias("estimate"))


@register("x8_canonical_json", """select l_orderkey, l_linenumber, sha256('{"flag":"' || l_returnflag || '","line":' || l_linenumber || ',"part":' || l_partkey || ',"status":"' || l_linestatus || '"}') as stamp from lineitem""")
def canonical_json(spark: SparkSession, d: str) -> DataFrame:
    """Stamps of rows: JSON with its keys in order and no white space."""
    fields = {"status": "l_linestatus", "part": "l_partkey", "line": "l_linenumber", "flag": "l_returnflag"}
    row = F.to_json(F.struct(*[F.col(fields[k]).alias(k) for k in sorted(fields)]))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.sha2(row, 256).alias("stamp"))


@register("p13_whole_words", "select doc_id, len(regexp_extract_all(lower(text), '(^|[^a-z0-9])token($|[^a-z0-9])')) > 0 as has_token, regexp_matches(lower(text), '(^|[^a-z0-9])light($|[^a-z0-9])') as has_light from documents where text is not null")
def whole_words(spark: SparkSession, d: str) -> DataFrame:
    has = lambda w: F.lower("text").rlike(rf"(?<![a-z0-9]){w}(?![a-z0-9])")
    return table(spark, d, "documents").filter("text is not null").select("doc_id", has("token").alias("has_token"), has("light").alias("has_light"))


_NAMED = "'Name of employee: ' || source || ' Smith' || chr(10) || 'Notes: ' || left(coalesce(text, ''), 40) || chr(10) || 'incumbent ' || lang"
LABELLED = r"(?im)^((?:name of employee|employee name|incumbent)[ \t]*:[ \t]*)[^\n]+"


@register("p24_labelled_names", rf"select doc_id, sha256(regexp_replace(n, '{LABELLED}', '\1[name redacted]', 'g')) as h, len(regexp_extract_all(n, '{LABELLED}')) as n_names from (select doc_id, {_NAMED} as n from documents)")
def labelled_names(spark: SparkSession, d: str) -> DataFrame:
    """What stands after the label of a name, to the end of its line, is masked and counted."""
    n = table(spark, d, "documents").select("doc_id", F.expr(_NAMED).alias("n"))
    return n.select("doc_id", F.sha2(F.regexp_replace("n", LABELLED, "$1[name redacted]"), 256).alias("h"), F.regexp_count("n", F.lit(LABELLED)).cast("long").alias("n_names"))


ASKED = ("larg", "brwn", "part")
_WORD_SIM = f"list_max(list_transform(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda t: len(list_intersect({TRI.format('t')}, {TRI.format(chr(39) + 'QQ' + chr(39))})) / len(list_distinct(list_concat({TRI.format('t')}, {TRI.format(chr(39) + 'QQ' + chr(39))})))))"


@register("f23_word_search", "with s as (select p_partkey, " + ", ".join(f"coalesce({_WORD_SIM.replace('QQ', w)}, 0) as s{i}" for i, w in enumerate(ASKED)) + " from part) select p_partkey, round((s0 + s1 + s2) / 3, 6) as similarity from s where greatest(s0, s1, s2) >= 0.5 and s2 >= 0.3")
def word_search(spark: SparkSession, d: str) -> DataFrame:
    """Titles by their words: each asked word's likeness to the title's most similar whole word."""
    words = T.tokens(F.col("p_name"))
    best = [F.coalesce(F.array_max(F.transform(words, lambda t, q=q: T.trigram_similarity(t, F.lit(q)))), F.lit(0.0)).alias(f"s{i}") for i, q in enumerate(ASKED)]
    s = table(spark, d, "part").select("p_partkey", *best)
    return s.filter((F.greatest("s0", "s1", "s2") >= 0.5) & (F.col("s2") >= 0.3)).select("p_partkey", F.round((F.col("s0") + F.col("s1") + F.col("s2")) / 3, 6).alias("similarity"))


_CUT = """hits as (select d.doc_id, d.text, b.text as p from documents d join benchmark b on length(b.text) > 0 and contains(d.text, b.text)),
 pos as (select distinct doc_id, text, i as s, i + length(p) as e from (select doc_id, text, p, unnest(list_filter(range(1, length(text) - length(p) + 2), lambda i: substring(text, i::int, length(p)::int) = p)) as i from hits)),
 mrk as (select *, coalesce(max(e) over (partition by doc_id order by s, e rows between unbounded preceding and 1 preceding), 0) as reach from pos),
 grp as (select *, sum(case when s >= reach then 1 else 0 end) over (partition by doc_id order by s, e) as g from mrk),
 cuts as (select doc_id, any_value(text) as text, g, min(s) as s, max(e) as e from grp group by doc_id, g),
 pcs as (select doc_id, g, substring(text, coalesce(lag(e) over (partition by doc_id order by g), 1)::int, (s - coalesce(lag(e) over (partition by doc_id order by g), 1))::int) as piece, substring(text, e::int) as rest, row_number() over (partition by doc_id order by g desc) as back from cuts),
 red as (select doc_id, string_agg(piece, ' ' order by g) || ' ' || any_value(rest) filter (where back = 1) as text, count(*) as n_cuts from pcs group by 1)"""


@register("p25_redacted", f"with {_CUT} select d.doc_id, coalesce(n_cuts, 0) as n_cuts, sha256(coalesce(red.text, d.text, '')) as h from documents d left join red using (doc_id)")
def redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every document without the benchmark's passages, whatever their length; overlapping occurrences are one cut."""
    return X.redacted(table(spark, d, "documents"), table(spark, d, "benchmark")).select("doc_id", "n_cuts", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))


# ---- candidates -----------------------------------------------------------------------------------
_CAND = f"kn as (select least(a, b) as a, greatest(a, b) as b, max(v) as v from (select x.vec_id as a, y.vec_id as b, {COS.format('x.embedding', 'y.embedding')} as v, row_number() over (partition by x.vec_id order by {COS.format('x.embedding', 'y.embedding')} desc, y.vec_id) as r from embeddings x join embeddings y on x.label = y.label and x.vec_id <> y.vec_id) where r <= 5 group by 1, 2)"


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """(a, b, v): nearest neighbours in a bucket, either way."""
    near = R.neighbours_in_bucket(table(spark, d, "embeddings"), 5)
    return near.groupBy(F.least("vec_id", "other").alias("a"), F.greatest("vec_id", "other").alias("b")).agg(F.max("score").alias("v"))


_OVER = f"""xa as (select a, b, unnest(t) as w from pr join tk on a = doc_id), xb as (select a, b, unnest(t) as w from pr join tk on b = doc_id),
 un as (select coalesce(xa.a, xb.a) as a, coalesce(xa.b, xb.b) as b, coalesce(xa.w, xb.w) as w, xa.w is not null and xb.w is not null as in_both from xa full join xb on xa.a = xb.a and xa.b = xb.b and xa.w = xb.w),
 sk as (select a, b, sum(case when in_both then idf else 0 end) / nullif(sum(idf), 0) as s from un join idf using (w) group by 1, 2)"""


def overlaps(spark: SparkSession, d: str, pairs: DataFrame) -> DataFrame:
    """(a, b, s): idf-weighted overlap of the words of each pair of documents.

    A document's words are one array of longs, each the word's number and, below, in how many documents
    it is. So a pair meets two arrays and never has a row for each word.
    """
    docs = table(spark, d, "documents")
    n = docs.count()
    ends = G.checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    words = S.numbered(document_frequencies(spark, d).select("w", "df"), "w").select("w", F.shiftleft("_i", 32).bitwiseOR(F.col("df")).alias("x"))
    tok = E.of_ids(docs, ends, ["doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("t")]).select("doc_id", F.explode("t").alias("w"))
    sets = G.checkpointed(tok.join(words, "w").groupBy("doc_id").agg(F.sort_array(F.collect_list("x")).alias("x")))
    weight = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + N.idf(F.lit(n), x.bitwiseAND((1 << 32) - 1)))
    one = pairs.select("a", "b").join(sets.toDF("a", "xa"), "a", "left").join(sets.toDF("b", "xb"), "b", "left").filter("xa is not null or xb is not null")
    none = F.array().cast("array<long>")
    xa, xb = F.coalesce("xa", none), F.coalesce("xb", none)
    both = one.select("a", "b", weight(xa).alias("wa"), weight(xb).alias("wb"), weight(F.array_intersect(xa, xb)).alias("w"))
    return both.select("a", "b", (F.col("w") / F.nullif(F.col("wa") + F.col("wb") - F.col("w"), F.lit(0.0))).alias("s"))


@register("m8_candidate_overlap", f"with {IDF}, {_CAND}, pr as (select a, b from kn join documents x on a = x.doc_id join documents y on b = y.doc_id), {_OVER} select a, b, round(s, 6) as overlap from sk")
def candidate_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Weighted overlap of all candidate pairs that the vectors give."""
    ids = table(spark, d, "documents").select("doc_id")
    pairs = G.checkpointed(candidates(spark, d).join(ids.withColumnRenamed("doc_id", "a"), "a", "left_semi").join(ids.withColumnRenamed("doc_id", "b"), "b", "left_semi").select("a", "b"))
    return overlaps(spark, d, pairs).select("a", "b", F.round("s", 6).alias("overlap"))


@register("m12_candidate_verdicts", f"with {_CAND} select a, b, round(v, 4) as s, case when round(v, 4) >= 0.92 then 'clone' when round(v, 4) < 0.6 then 'new_job' else 'uncertain' end as verdict from kn")
def candidate_verdicts(spark: SparkSession, d: str) -> DataFrame:
    s = candidates(spark, d).select("a", "b", F.round("v", 4).alias("s"))
    return s.withColumn("verdict", F.when(F.col("s") >= 0.92, "clone").when(F.col("s") < 0.6, "new_job").otherwise("uncertain"))


@register("m13_candidate_drift", f"with {GRAMS}, {TOK}, p as (select a, b, x.lang <> y.lang as e, len(list_intersect(tx.t, ty.t)) / len(list_distinct(list_concat(tx.t, ty.t))) as j from pairs join documents x on a = x.doc_id join documents y on b = y.doc_id join tk tx on tx.doc_id = a join tk ty on ty.doc_id = b where score >= 0.5) select a, b, round(1 - j, 4) as distance, e as other_language from p")
def candidate_drift(spark: SparkSession, d: str) -> DataFrame:
    """How far apart the words of near pairs are."""
    docs = table(spark, d, "documents")
    t = docs.select("doc_id", "lang", F.array_distinct(T.tokens(F.col("text"))).alias("t"))
    p = E.near_pairs(docs, DedupConfig(jaccard=0.5)).join(t.toDF("a", "la", "ta"), "a").join(t.toDF("b", "lb", "tb"), "b")
    return p.select("a", "b", F.round(1 - T.jaccard(F.col("ta"), F.col("tb")), 4).alias("distance"), (F.col("la") != F.col("lb")).alias("other_language"))


_BLEND = "round(least(1.0, greatest(0.0, 0.45 * v + 0.45 * coalesce(s, 0) + 0.10 * (case when bx = by_ then 1.0 else 0.7 end))), 4)"


ROLES = f"""{GRAMS}, {TOK}, {IDF[len(TOK) + 2 :]}, {_CAND}, seeds as (select a, b from pairs where score >= 0.85 and a in (select vec_id from embeddings) and b in (select vec_id from embeddings)),
 al as (select a, b from kn union select a, b from seeds), ve as (select al.a, al.b, greatest(0.0, least(1.0, {COS.format('x.embedding', 'y.embedding')})) as v from al join embeddings x on al.a = x.vec_id join embeddings y on al.b = y.vec_id),
 pr as (select ve.*, floor(log2(greatest(x.n_chars, 1)) / 3)::int as bx, floor(log2(greatest(y.n_chars, 1)) / 3)::int as by_, x.lang as lx, y.lang as ly from ve join documents x on a = x.doc_id join documents y on b = y.doc_id),
 {_OVER}, sc as (select pr.a, pr.b, {_BLEND} as score, case when abs(bx - by_) > 1 then 'band_veto' when lx <> ly then 'group_veto' when {_BLEND} < 0.5 then 'below_edge' end as dropped from pr left join sk on pr.a = sk.a and pr.b = sk.b)"""


@register("c3_role_edges", f"with {ROLES} select a, b, score, coalesce(dropped, 'edge') as outcome from sc")
def role_edges(spark: SparkSession, d: str) -> DataFrame:
    """Role equivalence whole: nearest neighbours and near-duplicate seeds, vetoes by band and group, blended score, floor."""
    ids = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return roles(spark, d, E.near_pairs(table(spark, d, "documents"), DedupConfig(), ids))


def roles(spark: SparkSession, d: str, near: DataFrame) -> DataFrame:
    """(a, b, score, outcome) of nearest neighbours and of the near pairs (a, b) that have vectors."""
    cfg, docs, vectors = CompareConfig(), table(spark, d, "documents"), table(spark, d, "embeddings")
    v = vectors.select("vec_id", "embedding")
    seeds = near.select("a", "b").join(v.toDF("a", "ea"), "a").join(v.toDF("b", "eb"), "b").select("a", "b", N.cosine(F.col("ea"), F.col("eb")).alias("v"))
    every = candidates(spark, d).unionByName(seeds).groupBy("a", "b").agg(N.clamped(F.max("v")).alias("v"))
    own = docs.select("doc_id", F.floor(F.log2(F.greatest("n_chars", F.lit(1))) / 3).cast("int").alias("band"), "lang")
    pairs = G.checkpointed(every.join(own.toDF("a", "bx", "lx"), "a").join(own.toDF("b", "by", "ly"), "b"))
    close = F.when(F.col("bx") == F.col("by"), 1.0).otherwise(cfg.unknown)
    scored = pairs.join(overlaps(spark, d, pairs), ["a", "b"], "left").withColumn("score", N.blended(F.col("v"), F.coalesce("s", F.lit(0.0)), close))
    reasons = [("band_veto", F.abs(F.col("bx") - F.col("by")) > cfg.band_gap), ("group_veto", F.col("lx") != F.col("ly")), ("below_edge", F.col("score") < cfg.edge)]
    return E.admitted(scored, reasons).select("a", "b", "score", F.coalesce("drop_reason", F.lit("edge")).alias("outcome"))


@register(
    "c5_clustering_pass",
    f"""with recursive {ROLES}, ed as (select rep as a, doc_id as b, 'exact' as tier from h join g using (sha) where doc_id <> rep union select a, b, 'near' from pairs where score >= 0.85 union select a, b, 'role' from sc where dropped is null and score >= 0.75),
 sy as (select a as u, b as v from ed union select b, a from ed), walk as (select u as v, u as c from sy union select sy.v, walk.c from walk join sy on sy.u = walk.v), lab as (select v, min(c) as c from walk group by v),
 et as (select c, count(*) filter (where tier = 'exact') as exact_edges, count(*) filter (where tier = 'near') as near_edges, count(*) filter (where tier = 'role') as role_edges from ed join lab on a = v group by 1)
 select lab.c as cluster_id, count(*) as size, any_value(exact_edges) as exact_edges, any_value(near_edges) as near_edges, any_value(role_edges) as role_edges, count(distinct source) > 1 as mixed, count(*) > 50 as oversize from lab join documents on v = doc_id join et on et.c = lab.c group by 1""",
)
def clustering_pass(spark: SparkSession, d: str) -> DataFrame:
    """Edges of all tiers as they are admitted, their components, and what each holds; odd ones are flagged, never split."""
    cfg, docs = CompareConfig(), table(spark, d, "documents")
    tier = lambda df, name: df.select("a", "b", F.lit(name).alias("tier"))
    near = G.checkpointed(E.near_pairs(docs, DedupConfig()))
    G.released(spark)
    role = G.checkpointed(roles(spark, d, near).filter((F.col("outcome") == "edge") & (F.col("score") >= cfg.role_edge)))
    G.released(spark)
    edges = G.checkpointed(tier(E.exact_star(docs), "exact").unionByName(tier(near, "near")).unionByName(tier(role, "role")).distinct())
    label = G.checkpointed(G.components(edges.select("a", "b")))
    n = lambda t: F.count_if(F.col("tier") == t).alias(f"{t}_edges")
    held = edges.join(label, F.col("a") == F.col("v")).groupBy("c").agg(n("exact"), n("near"), n("role"))
    size = label.join(docs, F.col("v") == F.col("doc_id")).groupBy("c").agg(F.count(F.lit(1)).alias("size"), (F.countDistinct("source") > 1).alias("mixed"), (F.count(F.lit(1)) > cfg.max_cluster).alias("oversize"))
    return size.join(held, "c").select(F.col("c").alias("cluster_id"), "size", "exact_edges", "near_edges", "role_edges", "mixed", "oversize")


# ---- merging --------------------------------------------------------------------------------------


@register(
    "c7_merged_records",
    """with t as (select conv_id, turn, role, text, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as w, len(regexp_extract_all(text, '[^ ]+')) as n from conversations),
 pool as (select *, max(case when n between 20 and 60 then 1 else 0 end) over (partition by conv_id) as any_fit from t), inn as (select * from pool where any_fit = 0 or n between 20 and 60),
 ce as (select x.conv_id, x.turn, x.text, round(coalesce(sum(case when y.turn is null then 0 when len(list_distinct(list_concat(x.w, y.w))) = 0 then 1.0 else len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) end), 0), 6) as s from inn x left join inn y on x.conv_id = y.conv_id and x.turn <> y.turn group by 1, 2, 3),
 su as (select conv_id, turn as summary_turn from (select *, row_number() over (partition by conv_id order by s desc, length(text), text, turn) as r from ce) where r = 1),
 ro as (select conv_id, role as title from (select conv_id, role, row_number() over (partition by conv_id order by count(*) desc, length(role), role) as r from t group by 1, 2) where r = 1),
 co as (select conv_id, count(*) as n_core from (select conv_id, x, count(*) as k from (select conv_id, turn, unnest(w) as x from t) group by 1, 2) join (select conv_id, count(*) as m from t group by 1) using (conv_id) where k >= 0.5 * m group by 1),
 lo as (select conv_id, turn as richest_turn from (select *, row_number() over (partition by conv_id order by len(w) desc, length(text) desc, turn) as r from t) where r = 1),
 ag as (select conv_id, count(*) as members, count(distinct lower(trim(text))) as n_statements, bool_or(contains(text, '?')) as asks, count(distinct role) > 1 as disagree, string_agg(turn::varchar, ',' order by turn) as provenance from t group by 1)
 select ag.conv_id, members, title, summary_turn, richest_turn, coalesce(n_core, 0) as n_core, n_statements, asks, provenance, concat_ws(',', case when members = 1 then 'single_member' end, case when coalesce(n_core, 0) = 0 then 'no_core_skills' end, case when n_statements > 12 then 'statements_over_max' end, case when disagree then 'role_disagreement' end) as flags
 from ag join su using (conv_id) join ro using (conv_id) join lo using (conv_id) left join co using (conv_id)""",
)
def merged_records(spark: SparkSession, d: str) -> DataFrame:
    """One record for each cluster, whatever the order of its members: modal title, most central summary of fitting length,
    richest member, core words, statements, presence, provenance and flags. Clusters over the bound on size are flagged before."""
    cfg = MergeConfig()
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.array_distinct(T.tokens(F.col("text"))).alias("w"), F.regexp_count("text", F.lit("[^ ]+")).alias("n"))
    fits = F.col("n").between(20, 60)
    some = c.groupBy("conv_id").agg(F.max(fits).alias("some"))
    pool = G.checkpointed(c.join(some, "conv_id").filter(~F.col("some") | fits).select("conv_id", "turn", "text", "w"))
    other = pool.select("conv_id", F.col("turn").alias("u"), F.col("w").alias("v"))
    like = pool.join(other, "conv_id").filter("turn <> u").groupBy("conv_id", "turn").agg(F.round(F.sum(T.jaccard(F.col("w"), F.col("v"), 1.0)), 6).alias("s"))
    central = pool.join(like, ["conv_id", "turn"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    order = lambda *x: F.min(F.struct(*[e.alias(f"o{i}") for i, e in enumerate(x)]))
    summary = central.groupBy("conv_id").agg(order(-F.col("s"), F.length("text"), F.col("text"), F.col("turn")).getField("o3").alias("summary_turn"))
    title = G.modal(c, ["conv_id"], "role", F.asc(F.length("role"))).select("conv_id", F.col("role").alias("title"))
    core = c.select("conv_id", F.explode("w").alias("x")).groupBy("conv_id", "x").agg(F.count(F.lit(1)).alias("k"))
    whole = c.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("members"), F.countDistinct(F.lower(F.trim("text"))).alias("n_statements"), F.max(F.contains("text", F.lit("?"))).alias("asks"), (F.countDistinct("role") > 1).alias("disagree"),
        F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda x: x.cast("string")), ",").alias("provenance"), order(-F.size("w"), -F.length("text"), F.col("turn")).getField("o2").alias("richest_turn"),
    )
    core = core.join(whole.select("conv_id", "members"), "conv_id").filter(F.col("k") >= cfg.core_share * F.col("members")).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_core"))
    out = whole.join(summary, "conv_id").join(title, "conv_id").join(core, "conv_id", "left").withColumn("n_core", F.coalesce("n_core", F.lit(0)))
    flags = F.concat_ws(",", F.when(F.col("members") == 1, "single_member"), F.when(F.col("n_core") == 0, "no_core_skills"), F.when(F.col("n_statements") > cfg.max_statements, "statements_over_max"), F.when(F.col("disagree"), "role_disagreement"))
    return out.select("conv_id", "members", "title", "summary_turn", "richest_turn", "n_core", "n_statements", "asks", "provenance", flags.alias("flags"))


_P = "p as (select x.conv_id, len(list_intersect(x.w, y.w)) / greatest(len(list_distinct(list_concat(x.w, y.w))), 1) as j from t x join t y on x.conv_id = y.conv_id and x.turn < y.turn)"


@register(
    "a26_harmonization_folds",
    f"""with t as (select conv_id, turn, role, length(text) as l, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from conversations), {_P},
 c as (select conv_id, count(*) as members, max(l) - min(l) as spread, count(distinct role) as roles, avg(l) as mean from t group by 1), m as (select conv_id, max(n) as top from (select conv_id, role, count(*) as n from t group by 1, 2) group by 1),
 z as (select conv_id, avg(j) as mj, min(j) as nj from p group by 1)
 select 'members' as fold, members::varchar as bin, count(*) as n from c group by 2 union all select 'spread', (spread // 100)::varchar, count(*) from c group by 2 union all select 'roles', roles::varchar, count(*) from c group by 2
 union all select 'max_is_modal', (top * 2 > members)::varchar, count(*) from c join m using (conv_id) group by 2 union all select 'pair_jaccard', floor(j * 20)::int::varchar, count(*) from p group by 2
 union all select 'least_jaccard', floor(nj * 20)::int::varchar, count(*) from z group by 2 union all select 'role_turns', role || ':' || turn, count(*) from t group by 2
 union all select 'sweep_clusters', th::varchar, (select count(*) from z where mj * 20 >= th) from range(0, 21) as s(th) union all select 'sweep_pairs', th::varchar, (select count(*) from p where j * 20 >= th) from range(0, 21) as s(th)""",
)
def harmonization_folds(spark: SparkSession, d: str) -> DataFrame:
    """Nine folds over clusters, whatever their order: histograms, spreads, modal shares, pairwise similarity, sweeps."""
    t = G.checkpointed(table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("l"), F.array_distinct(T.tokens(F.col("text"))).alias("w")))
    o = t.select("conv_id", F.col("turn").alias("u"), F.col("w").alias("v"))
    p = G.checkpointed(t.join(o, "conv_id").filter("turn < u").select("conv_id", T.jaccard(F.col("w"), F.col("v")).alias("j")))
    c = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("members"), (F.max("l") - F.min("l")).alias("spread"), F.countDistinct("role").alias("roles"))
    m = t.groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n")).groupBy("conv_id").agg(F.max("n").alias("top"))
    z = p.groupBy("conv_id").agg(F.avg("j").alias("mj"), F.min("j").alias("nj"))
    fold = lambda name, df, b: df.groupBy(b.cast("string").alias("bin")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("fold"), "bin", "n")
    steps = F.sequence(F.lit(0), F.lit(20))
    # a sweep is a count for each threshold that a value reaches, so no threshold meets every row
    sweep = lambda name, df, v: spark.range(21).select(F.col("id").cast("string").alias("bin")).join(df.select(F.explode(F.filter(steps, lambda s: v * 20 >= s)).alias("step")).groupBy(F.col("step").cast("string").alias("bin")).agg(F.count(F.lit(1)).alias("n")), "bin", "left").select(F.lit(name).alias("fold"), "bin", F.coalesce("n", F.lit(0)).alias("n"))
    parts = [
        fold("members", c, F.col("members")), fold("spread", c, F.floor(F.col("spread") / 100)), fold("roles", c, F.col("roles")), fold("max_is_modal", c.join(m, "conv_id"), F.col("top") * 2 > F.col("members")),
        fold("pair_jaccard", p, F.floor(F.col("j") * 20).cast("int")), fold("least_jaccard", z, F.floor(F.col("nj") * 20).cast("int")), fold("role_turns", t, F.concat("role", F.lit(":"), "turn")),
        sweep("sweep_clusters", z, F.col("mj")), sweep("sweep_pairs", p, F.col("j")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


# ---- reviews --------------------------------------------------------------------------------------
#: State and event to the next state; an approved draft goes only when a new one supersedes it.
REVIEW = {("none", "signup"): "draft", ("none", "view"): "draft", ("draft", "click"): "edited", ("edited", "click"): "edited", ("draft", "purchase"): "approved", ("edited", "purchase"): "approved", ("draft", "error"): "rejected", ("edited", "error"): "rejected", ("rejected", "signup"): "draft", ("approved", "signup"): "superseded", ("superseded", "view"): "draft"}
_NEXT = "case " + " ".join(f"when STATE = '{s}' and e.event_type = '{e}' then '{n}'" for (s, e), n in REVIEW.items()) + " end"
REVIEWED = f"""e as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) as i from events),
 w as (select user_id, event_id, event_type, i, 'none' as before, coalesce({_NEXT.replace('STATE', "'none'")}, 'none') as after, {_NEXT.replace('STATE', "'none'")} is not null as allowed from e where i = 1
  union all select e.user_id, e.event_id, e.event_type, e.i, w.after, coalesce({_NEXT.replace('STATE', 'w.after')}, w.after), {_NEXT.replace('STATE', 'w.after')} is not null from w join e on e.user_id = w.user_id and e.i = w.i + 1)"""


@register("c19_review_log", f"with recursive {REVIEWED} select user_id, event_id, event_type, before, after, allowed from w")
def review_log(spark: SparkSession, d: str) -> DataFrame:
    """Every review action with the state before and after it; refused ones change nothing."""
    return St.walked(table(spark, d, "events"), "user_id", ["event_id"], "event_type", REVIEW, "none")


@register("c19_review_outcomes", f"with recursive {REVIEWED} select user_id, arg_max(after, i) as state, count(*) filter (where allowed) as actions, count(*) filter (where not allowed) as refused, count(*) filter (where allowed and after = 'approved') as approvals, count(*) filter (where allowed and after = 'superseded') as superseded from w group by 1")
def review_outcomes(spark: SparkSession, d: str) -> DataFrame:
    w = St.walked(table(spark, d, "events"), "user_id", ["event_id"], "event_type", REVIEW, "none")
    done = lambda s: F.count_if(F.col("allowed") & (F.col("after") == s))
    return w.groupBy("user_id").agg(F.max_by("after", "event_id").alias("state"), F.count_if("allowed").alias("actions"), F.count_if(~F.col("allowed")).alias("refused"), done("approved").alias("approvals"), done("superseded").alias("superseded"))


# ---- search ---------------------------------------------------------------------------------------


@register("c18_guard", f"with t as (select p_partkey, p_brand, {TITLE_SQL} as title from part), x as (select lower(title) as k, count(*) as n, min(p_partkey) as first from t group by 1) select p_partkey, n - 1 as collisions, case when n > 1 and p_partkey <> first then 'warn' when n > 1 then 'first' else 'clear' end as verdict from t join x on lower(t.title) = x.k where p_brand <> 'Brand#1'")
def guard(spark: SparkSession, d: str) -> DataFrame:
    """Titles that are there already, counted over all, but for excluded rows."""
    t = titles(spark, d).withColumn("k", F.lower("title"))
    x = t.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))
    verdict = F.when((F.col("n") > 1) & (F.col("p_partkey") != F.col("first")), "warn").when(F.col("n") > 1, "first").otherwise("clear")
    return t.join(x, "k").filter("p_brand <> 'Brand#1'").select("p_partkey", (F.col("n") - 1).alias("collisions"), verdict.alias("verdict"))


@register("j7_lateral_lineage", "select o_orderkey, x.parts, x.flagged from orders o, lateral (select count(distinct l_partkey) as parts, count(*) filter (where l_returnflag = 'R') as flagged from lineitem where l_orderkey = o.o_orderkey) x")
def lateral_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Each record with what its lineage says, records without any too: an aggregate by key and a left join."""
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_partkey").alias("parts"), F.count_if(F.col("l_returnflag") == "R").alias("flagged"))
    o = table(spark, d, "orders").select("o_orderkey").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", F.coalesce("parts", F.lit(0)).alias("parts"), F.coalesce("flagged", F.lit(0)).alias("flagged"))


@register("j16_contained_members", "with m as (select o_custkey as role, list(o_orderkey) as members from orders group by 1), hits as (select l_orderkey from lineitem where l_quantity >= 49 group by 1) select role, count(*) as documents from m, hits where list_contains(members, l_orderkey) group by 1")
def contained_members(spark: SparkSession, d: str) -> DataFrame:
    """Roles whose members hold any of the hits: members once each and an equi-join in place of one containment per hit."""
    hits = table(spark, d, "lineitem").filter("l_quantity >= 49").select("l_orderkey").distinct()
    return table(spark, d, "orders").join(hits, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("role")).agg(F.countDistinct("o_orderkey").alias("documents"))


@register("p1_current_rows", "select o_orderkey from orders where o_orderstatus = 'F'")
def current_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows under one stamp: an equality that reaches the scan."""
    return table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")


# ---- sources and sinks ----------------------------------------------------------------------------


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/skein/{name}-{uuid.uuid4().hex}"


@register("s1_archive_walk", "select source, count(*) as rows, 'read' as status from documents group by 1")
def archive_walk(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as files, found by a recursive walk, decoded and counted by the folder they lie in."""
    at = folder(spark, "archive")
    table(spark, d, "documents").select("source", "doc_id", "lang").write.partitionBy("source").json(at)
    files = S.archive(spark, at).filter(F.col("path").endswith(".json"))
    lines = F.size(F.filter(F.split(S.decoded(F.col("content")), "\n"), lambda x: x != ""))
    return files.groupBy(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), "status").agg(F.sum(lines.cast("long")).alias("rows")).select("source", "rows", "status")


@register("s4_size_guard", "select 'too_large' as status, count(distinct source) as folders, 0::bigint as contents from documents")
def size_guard(spark: SparkSession, d: str) -> DataFrame:
    """Files over the cap are listed and never read."""
    at = folder(spark, "guard")
    table(spark, d, "documents").select("source", "doc_id", "lang").write.partitionBy("source").json(at)
    files = S.archive(spark, at, max_bytes=1).filter(F.col("path").endswith(".json"))
    return files.groupBy("status").agg(F.countDistinct(F.regexp_extract("path", "source=([^/]+)/", 1)).alias("folders"), F.count("content").alias("contents"))


@register("s7_decoded_bytes", "select doc_id, length(replace(coalesce(text, ''), 'e', '')) as n from documents")
def decoded_bytes(spark: SparkSession, d: str) -> DataFrame:
    """UTF-16 bytes with a mark, with NULs among them, read back as text without NULs."""
    raw = F.encode(F.concat(F.lit("﻿"), F.translate(F.coalesce("text", F.lit("")), "e", "\x00")), "UTF-16BE")
    return table(spark, d, "documents").select("doc_id", F.length(S.decoded(raw)).cast("int").alias("n"))


@register("s8_resumed_ingest", "select event_type, count(*) as n, sum(event_id)::bigint as ids from events group by 1")
def resumed_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Files that arrive between two runs of an ingest are each taken once; a third run takes nothing."""
    incoming, out, state = (folder(spark, x) for x in ("incoming", "ingested", "state"))
    e = table(spark, d, "events")
    for part in (0, 1, None):
        if part is not None:
            e.filter(F.pmod(F.xxhash64("event_id"), F.lit(2)) == part).write.mode("append").parquet(incoming)
        Z.ingest_available(Z.arriving(spark, incoming, e.schema), out, state)
    return spark.read.schema(e.schema).parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@register("s13_json_lines", "select doc_id, lang, source, n_chars, sha256(coalesce(text, '')) as h from documents")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Rows as JSON lines and back by a stated schema."""
    at, docs = folder(spark, "jsonl"), table(spark, d, "documents")
    docs.write.json(at)
    back = S.jsonl(spark, at, docs.schema)
    return back.filter("_corrupt is null").select("doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))


@register("s16_csv_artifact", "select lang, source, count(*) as n from documents group by 1, 2")
def csv_artifact(spark: SparkSession, d: str) -> DataFrame:
    """A report written as CSV in a stable order, and read back."""
    at = folder(spark, "report")
    S.write_artifact(table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")), at, "csv", "lang", "source")
    return spark.read.schema("lang string, source string, n long").option("header", True).csv(at)


@register("z2_audit_append", "select event_type, count(*) as n, count(distinct event_id) as ids from events group by 1")
def audit_append(spark: SparkSession, d: str) -> DataFrame:
    """An append-only log: batches are added, what is there is skipped, nothing is rewritten."""
    at, e = folder(spark, "audit"), table(spark, d, "events").select("event_id", "event_type")
    e.filter("event_id % 3 = 0").write.parquet(at)
    S.new_rows(e.filter("event_id % 3 < 2"), spark.read.parquet(at), ["event_id"]).write.mode("append").parquet(at)
    S.new_rows(e, spark.read.parquet(at), ["event_id"]).write.mode("append").parquet(at)
    return spark.read.parquet(at).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


@register(
    "s17_reconciled_table",
    "select o_orderkey, o_totalprice, case when o_orderkey % 4 = 0 then 'insert' when o_orderkey % 4 = 1 then 'update' else 'unchanged' end as action from orders where o_orderkey % 5 <> 0 union all select o_orderkey, null, 'prune' from orders where o_orderkey % 5 = 0 and o_orderkey % 4 <> 0",
)
def reconciled_table(spark: SparkSession, d: str) -> DataFrame:
    """A stored table brought to what was computed: rows added, changed, left and gone, written as its next version."""
    at = folder(spark, "edges")
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    o.filter("o_orderkey % 4 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 4 == 1, -1.0).otherwise(F.col("o_totalprice"))).write.parquet(f"{at}/1")
    plan, present = o.filter("o_orderkey % 5 <> 0"), spark.read.parquet(f"{at}/1")
    both = plan.join(present.withColumnRenamed("o_totalprice", "old"), "o_orderkey", "full_outer")
    action = F.when(F.col("old").isNull(), "insert").when(F.col("o_totalprice").isNull(), "prune").when(F.col("old") == F.col("o_totalprice"), "unchanged").otherwise("update")
    both.withColumn("action", action).write.parquet(f"{at}/2")
    return spark.read.parquet(f"{at}/2").select("o_orderkey", "o_totalprice", "action")
