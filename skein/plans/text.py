"""Text, extraction and scalar queries over ``documents``, ``pages``, ``part`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import ranking as R
from skein.operators import redaction as X
from skein.sources import tables as S
from skein.sources.tables import table

from .registry import register

#: The title ladders, first match wins, and what ends the part of a title that counts.
FAMILIES = {
    "vp": ["vice president", "associate vice", " avp ", " vp "],
    "chief": ["chief", " cio ", " cfo ", " cto ", " ceo ", " coo "],
    "manager": ["associate director", "manager", "supervisor"],
    "director": ["director"],
    "lead": ["team lead", " lead "],
    "assistant": ["assistant"],
    "associate": ["associate", "representative"],
}
FUNCTIONS = {
    "executive": ["executive"], "associate_director": ["associate director"], "director": ["director"], "manager": ["manager"], "consultant": ["consultant"],
    "specialist": ["specialist"], "officer": ["officer"], "analyst": ["analyst"], "coordinator": ["coordinator"], "assistant": ["assistant"],
}
MARKERS = (" to ", " office of ")
SUPERVISORY = ("vp", "chief", "director", "manager", "lead")

#: Titles made from the parts' keys, as the parts' own names hold none of the ladders' words.
TITLES = ("Director, Finance", "Assistant to the Vice President", "Team Lead Analyst", "Manager of Parts", "Associate Director", "Chief Officer", "Program Coordinator", "Representative", "Plumber", "Office of the Director")
TITLE_SQL = "case p_partkey % 10 " + " ".join(f"when {i} then '{t}'" for i, t in enumerate(TITLES)) + " end"


def titles(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(t) for t in TITLES])
    return table(spark, d, "part").select("p_partkey", "p_name", "p_brand", F.get(names, (F.col("p_partkey") % 10).cast("int")).alias("title"))


def ladder_sql(padded: str, ladder: dict[str, list[str]], markers: tuple[str, ...]) -> str:
    cut = ", ".join(f"nullif(instr({padded}, '{m}'), 0)" for m in markers)
    head = f"(substring({padded}, 1, coalesce(least({cut}), 1000000)::int - 1) || ' ')" if markers else padded
    return "case " + " ".join("when " + " or ".join(f"contains({head}, '{w}')" for w in words) + f" then '{rung}'" for rung, words in ladder.items()) + " else 'unmapped' end"


PADDED = f"(' ' || trim(regexp_replace(lower({TITLE_SQL}), '[^a-z0-9]+', ' ', 'g')) || ' ')"


@register("title_taxonomy", f"select p_partkey, {ladder_sql(PADDED, FAMILIES, MARKERS)} as family, {ladder_sql(PADDED, FUNCTIONS, ())} as func, {ladder_sql(PADDED.replace(TITLE_SQL, f'split_part({TITLE_SQL}, chr(44), 1)'), FAMILIES, MARKERS)} in ('vp','chief','director','manager','lead') and contains({TITLE_SQL}, ',') as comma_supervisory from part")
def title_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    t = titles(spark, d)
    pad = T.padded_title(F.col("title"))
    head = T.padded_title(F.get(F.split("title", ",", 2), F.lit(0)))
    return t.select(
        "p_partkey",
        T.first_keyword(pad, FAMILIES, MARKERS).alias("family"),
        T.first_keyword(pad, FUNCTIONS).alias("func"),
        (T.first_keyword(head, FAMILIES, MARKERS).isin(*SUPERVISORY) & F.contains("title", F.lit(","))).alias("comma_supervisory"),
    )


@register("f4_normalized_titles", f"select p_partkey, array_to_string(list_filter(regexp_extract_all(lower({TITLE_SQL}), '[a-z0-9]+'), lambda x: x not in ('of', 'the', 'to', 'and')), ' ') as normalized from part")
def normalized_titles(spark: SparkSession, d: str) -> DataFrame:
    return titles(spark, d).select("p_partkey", T.normalized_title(F.col("title"), ("of", "the", "to", "and")).alias("normalized"))


@register("f2_token_counts", "select doc_id, len(t) as n_tokens, len(list_distinct(t)) as n_distinct from (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as t from documents)")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


FOLD_SQL = "{0}"
for _a, _b in (("\\p{Cf}", ""),):
    FOLD_SQL = f"regexp_replace({FOLD_SQL}, '{_a}', '{_b}', 'g')"
FOLD_SQL = f"translate({FOLD_SQL}, '‘’‚‛′“”„″‐‑‒–—―−', '''''''''''\"\"\"\"-------')"
for _a, _b in T.LIGATURES.items():
    FOLD_SQL = f"replace({FOLD_SQL}, '{_a}', '{_b}')"
FOLD_SQL = f"lower(trim(regexp_replace({FOLD_SQL}, '\\s+', ' ', 'g')))"


@register("text_fold", f"select conv_id, turn, length(f) as n, sha256(f) as h from (select conv_id, turn, {FOLD_SQL.replace('{0}', 'text').replace('{Cf}', '{Cf}')} as f from conversations where not regexp_matches(text, '\\n\\s*\\n'))")
def text_fold(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").filter(~F.col("text").rlike(r"\n\s*\n")).select("conv_id", "turn", T.fold(F.col("text")).alias("f"))
    return c.select("conv_id", "turn", F.length("f").cast("long").alias("n"), F.sha2("f", 256).alias("h"))


_PII = rf"regexp_replace(regexp_replace(text, '{T.EMAIL}', '[contact redacted]', 'g'), '{T.PHONE}', '[contact redacted]', 'g')"


@register("pii_scrub", f"select doc_id, sha256({_PII}) as h, len(regexp_extract_all(text, '{T.EMAIL}')) as n_email, len(regexp_extract_all(regexp_replace(text, '{T.EMAIL}', '', 'g'), '{T.PHONE}')) as n_phone from documents")
def pii_scrub(spark: SparkSession, d: str) -> DataFrame:
    left = F.regexp_replace("text", T.EMAIL, "")
    return table(spark, d, "documents").select(
        "doc_id", F.sha2(T.scrubbed(F.col("text")), 256).alias("h"), F.regexp_count("text", F.lit(T.EMAIL)).cast("long").alias("n_email"), F.regexp_count(left, F.lit(T.PHONE)).cast("long").alias("n_phone")
    )


@register("boilerplate_redaction", "select b.item_id, count(*) as docs, sum(length(b.text))::bigint as chars from benchmark b join documents d on contains(d.text, b.text) group by 1")
def boilerplate(spark: SparkSession, d: str) -> DataFrame:
    """How many documents hold each passage verbatim, whatever its length."""
    held = X.holding(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return held.groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("passage")).alias("chars"))


@register("s2_url_format", "select format, count(*) as n from (select case when e in ('docx','doc','rtf','txt') then e else 'other' end as format from (select lower(regexp_extract(url, '\\.([^./]+)$', 1)) as e from pages)) group by 1")
def url_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy(S.detect_format(F.col("url")).alias("format")).agg(F.count(F.lit(1)).alias("n"))


@register("s3_content_hash", "select page_id, sha256(html) as sha256, strlen(html) as bytes from pages")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("bytes"))


TAGS = r"<(script|style|title)[^>]*>[^<]*</(script|style|title)>|<!--[^>]*-->"


@register("html_extract", rf"select page_id, length(t) as n_chars, len(regexp_extract_all(t, '[^ ]+')) as n_words, sha256(t) as h from (select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '{TAGS}', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) as t from pages)")
def html_extract(spark: SparkSession, d: str) -> DataFrame:
    t = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("html", TAGS, " "), "<[^>]*>", " "), r"\s+", " "))
    return table(spark, d, "pages").select("page_id", t.alias("t")).select("page_id", F.length("t").cast("long").alias("n_chars"), F.regexp_count("t", F.lit("[^ ]+")).cast("long").alias("n_words"), F.sha2("t", 256).alias("h"))


@register("url_facets", r"select page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) as host, regexp_extract(url, '/([a-z]{2})/', 1) as lang, try_cast(nullif(regexp_extract(url, '/([0-9]+)', 1), '') as bigint) as path_id, lpad(regexp_extract(url, '/([0-9]+)', 1), 8, '0') as padded, contains(url, 'utm_') as tracked from pages")
def url_facets(spark: SparkSession, d: str) -> DataFrame:
    number = F.regexp_extract("url", r"/([0-9]+)", 1)
    return table(spark, d, "pages").select(
        "page_id",
        F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"),
        F.regexp_extract("url", r"/([a-z]{2})/", 1).alias("lang"),
        F.nullif(number, F.lit("")).try_cast("long").alias("path_id"),
        F.lpad(number, 8, "0").alias("padded"),
        F.contains("url", F.lit("utm_")).alias("tracked"),
    )


@register("f13_page_sections", r"select page_id, count(*) as n_lines, count(*) filter (where regexp_matches(l, '^<h[1-6]')) as n_headings, sum(length(l))::bigint as n_chars from (select page_id, unnest(string_split(regexp_replace(html, '<(h[1-6]|p|li)[ >]', chr(10) || '<\1>', 'g'), chr(10))) as l from pages) where l <> '' group by 1")
def page_sections(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "pages").select("page_id", F.explode(F.split(F.regexp_replace("html", "<(h[1-6]|p|li)[ >]", "\n<$1>"), "\n")).alias("l")).filter("l <> ''")
    return lines.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("l").rlike("^<h[1-6]")).alias("n_headings"), F.sum(F.length("l")).alias("n_chars"))


@register("title_search", f"select p_partkey, title, tier, row_number() over (order by tier, lower(title), p_partkey) as rank from (select p_partkey, {TITLE_SQL} as title, case when lower({TITLE_SQL}) = 'associate director' then 0 when starts_with(lower({TITLE_SQL}), 'associate director') then 1 when contains(lower({TITLE_SQL}), 'director') then 2 end as tier from part) where tier is not null")
def title_search(spark: SparkSession, d: str) -> DataFrame:
    t = titles(spark, d).withColumn("tier", F.coalesce(F.when(R.title_tier(F.col("title"), "associate director") < 2, R.title_tier(F.col("title"), "associate director")), R.title_tier(F.col("title"), "director")))
    t = t.withColumn("tier", F.when(F.startswith(F.lower("title"), F.lit("director")), 2).otherwise(F.col("tier"))).filter("tier is not null")
    numbered = S.numbered(t.withColumn("k", F.lower("title")), "tier", "k", "p_partkey")
    return numbered.select("p_partkey", "title", "tier", (F.col("_i") + 1).alias("rank"))


TRI = "list_distinct(flatten(list_transform(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i::int, 3)))))"


@register("typo_search", f"with t as (select p_partkey, p_name, {TRI.format('p_name')} as a, {TRI.format(chr(39) + 'larg brwn part' + chr(39))} as b from part) select p_partkey, round(s, 6) as similarity from (select p_partkey, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) as s from t) where s >= 0.1")
def typo_search(spark: SparkSession, d: str) -> DataFrame:
    s = T.trigram_similarity(F.col("p_name"), F.lit("larg brwn part"))
    return table(spark, d, "part").select("p_partkey", s.alias("s")).filter("s >= 0.1").select("p_partkey", F.round("s", 6).alias("similarity"))


@register("p3_contains_ci", "select doc_id from documents where contains(lower(text), 'licensed under cc by')")
def contains_ci(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(T.contains_ci(F.col("text"), "Licensed under CC BY")).select("doc_id")


@register("p4_distinct_from", "select lang is distinct from 'en' as other, count(*) as n from documents group by 1")
def distinct_from(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy((~F.col("lang").eqNullSafe("en")).alias("other")).agg(F.count(F.lit(1)).alias("n"))


@register("p10_word_term", "select doc_id from documents where regexp_matches(lower(text), '(^|[^a-z0-9])(token|license)([^a-z0-9]|$)')")
def word_term(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(F.lower("text").rlike("(^|[^a-z0-9])(token|license)([^a-z0-9]|$)")).select("doc_id")


@register("p22_grounded_evidence", "select l.conv_id, l.turn from conversations l join conversations r on l.conv_id = r.conv_id and l.turn = r.turn + 1 where contains(lower(l.text), lower(substring(r.text, 1, 12)))")
def grounded_evidence(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    r = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lower(F.substring("text", 1, 12)).alias("evidence"))
    return c.join(r, ["conv_id", "turn"]).filter(F.contains(F.lower("text"), F.col("evidence"))).select("conv_id", "turn")


@register("p23_token_grounding", "with b as (select list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z0-9]+')))) as v from benchmark), t as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as t from documents) select doc_id, len(t) = 0 or len(list_filter(t, lambda x: list_contains(v, x))) >= 0.8 * len(t) as grounded from t, b")
def token_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Whether 80 % of a document's tokens are words of the benchmark. The vocabulary is joined, not collected."""
    vocabulary = table(spark, d, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("w")).distinct().withColumn("known", F.lit(1))
    tok = table(spark, d, "documents").select("doc_id", F.explode_outer(T.tokens(F.col("text"))).alias("w"))
    n = tok.groupBy("doc_id", "w").agg(F.count("w").alias("k")).join(vocabulary, "w", "left")
    return n.groupBy("doc_id").agg((F.sum(F.when(F.col("known") == 1, F.col("k")).otherwise(0)) >= 0.8 * F.sum("k")).alias("grounded"))


@register("p27_position_query", "select p_partkey, lpad(regexp_extract('#' || p_partkey, '^#?([0-9]{1,8})$', 1), 8, '0') as position from part")
def position_query(spark: SparkSession, d: str) -> DataFrame:
    q = F.concat(F.lit("#"), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select("p_partkey", F.lpad(F.regexp_extract(q, "^#?([0-9]{1,8})$", 1), 8, "0").alias("position"))


@register("section_serializer", "with recursive c as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) as i from conversations), w as (select conv_id, i, case when length(text) > 400 then '' else text end as s, length(text) > 400 as stop from c where i = 1 union all select w.conv_id, c.i, case when w.stop or length(w.s) + length(c.text) + (case when w.s = '' then 0 else 1 end) > 400 then w.s when w.s = '' then c.text else w.s || chr(10) || c.text end, w.stop or length(w.s) + length(c.text) + (case when w.s = '' then 0 else 1 end) > 400 from w join c on c.conv_id = w.conv_id and c.i = w.i + 1) select conv_id, length(arg_max(s, i)) as n, sha256(arg_max(s, i)) as h from w group by 1")
def section_serializer(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("p"))
    s = parts.select("conv_id", T.serialized(F.col("p"), 400).alias("s"))
    return s.select("conv_id", F.length("s").cast("long").alias("n"), F.sha2("s", 256).alias("h"))


@register("s14_grade_csv", "with l as (select p_partkey as i, (p_partkey % 50) as position, case when p_partkey % 4 = 0 then '' else p_brand end as scheme, p_size as grade from part) select position::varchar as position_number, coalesce(nullif(arg_max(scheme, i), ''), 'unknown') as scheme, arg_max(grade, i)::varchar as grade from l group by position")
def grade_csv(spark: SparkSession, d: str) -> DataFrame:
    brand = F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_brand"))
    lines = table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.concat_ws(",", (F.col("p_partkey") % 50).cast("string"), brand, F.col("p_size").cast("string")).alias("value"))
    return S.csv_last(lines, "position_number string, scheme string, grade string", "position_number", "i", {"scheme": "unknown"})


@register("s15_strided_sample", "with n as (select doc_id, row_number() over (order by doc_id) - 1 as i, count(*) over () as n from documents) select doc_id from n where i in (select floor(k * (select count(*) from documents) / 25) from range(25) t(k))")
def strided_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.strided(table(spark, d, "documents").select("doc_id"), 25, "doc_id")


@register("x7_content_ids", "select source, substring(sha256(string_agg(doc_id::varchar, chr(10) order by doc_id::varchar)), 1, 12) as stamp from documents group by 1")
def content_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = F.array_sort(F.collect_list(F.col("doc_id").cast("string")))
    return table(spark, d, "documents").groupBy("source").agg(F.substring(F.sha2(F.array_join(ids, "\n"), 256), 1, 12).alias("stamp"))
