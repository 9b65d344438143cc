"""Records made of ``documents``, parsed out of their text, and rules and gates over them.

The tables hold prose without forms, so each document's sentences are first set into a form with
headings, bullets and wrapped lines (one rule for both engines); what is parsed out of it is checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import parsing as P
from skein.operators import records as B
from skein.sources.tables import table

from .registry import register


def _form(s) -> list[str]:
    """The lines of the form, as expressions that both engines read; null lines are left out. ``s(k)`` is sentence k."""
    when = lambda cond, x: f"case when {cond} then {x} end"
    out = [
        "'Title: ' || case doc_id % 6 when 0 then 'Senior ' when 1 then 'Executive Director, ' when 2 then 'Registrar, ' when 3 then 'Human Resources ' else '' end || source",
        when("doc_id % 3 <> 0", "'Pay grade: ' || cast(doc_id % 17 as varchar(9))"),
        "'A. Position   Summary:'",
        when(f"{s(1)} <> ''", s(1)),
        when(f"{s(2)} <> '' and doc_id % 3 = 1", s(2) + " || case when doc_id % 11 = 1 then ' on call' when doc_id % 13 = 1 then ' I am' else '' end"),
        "'DUTIES & RESPONSIBILITIES'",
    ]
    for k in range(3, 10):
        pct = f"case when doc_id % 2 = 0 and {k} <= 5 then case doc_id % 4 when 0 then ' (33%)' else ' (40 %)' end else '' end"
        out.append(when(f"{s(k)} <> '' and doc_id % 9 >= {k - 3}", f"case when (doc_id + {k}) % 3 = 0 then '- Manages ' else '- ' end || {s(k)} || {pct}"))
        out.append(when(f"{s(k)} <> '' and doc_id % 9 >= {k - 3} and {k} % 3 = 0", "'as it is agreed; or not; in time'"))
    out += [
        when("doc_id % 4 <> 0", "'B) Decision-Making'"),
        when(f"doc_id % 4 <> 0 and {s(4)} <> ''", f"'• ' || {s(4)}"),
        when("doc_id % 5 <> 0", "'Problem solving'"),
        when("doc_id % 5 <> 0", "'Solves:'"),
        when(f"doc_id % 5 <> 0 and {s(5)} <> ''", f"'• ' || {s(5)}"),
        "'Relationships'",
        when("doc_id % 2 = 0", "'* Establishes and maintains relationships and alliances'"),
        when(f"doc_id % 3 <> 0 and {s(6)} <> ''", f"'* Supervises ' || {s(6)}"),
        when("doc_id % 8 <> 7", "'Minimum Qualifications'"),
        when("doc_id % 8 <> 7 and doc_id % 4 = 1", "'* Advanced skills in writing'"),
        when("doc_id % 8 <> 7 and doc_id % 5 <> 2", "'* Excellent knowledge of rivers'"),
        when("doc_id % 8 <> 7 and doc_id % 5 = 2", "'* Good knowledge of rivers'"),
        when("doc_id % 8 <> 7 and doc_id % 3 = 0", "'* Skills in speech'"),
        when("doc_id % 8 <> 7 and doc_id % 7 < 4", "'* Ability to listen'"),
        when("doc_id % 8 <> 7 and doc_id % 7 = 5", "'* A bachelor degree' || case when doc_id % 2 = 0 then ' in a related field' else '' end"),
        when("doc_id % 8 <> 7 and doc_id % 7 = 6", "'* Certificates may include assets'"),
        when("doc_id % 3 = 1", "'* Five years, or an equivalent combination'"),
        when("doc_id % 10 = 3", "'* [insert more]'"),
        when("doc_id % 12 = 5", "'* The chairman, an individual in whom we trust'"),
        "'Additional Information'",
        when("lang <> 'de'", "'About us: a compassionate community.'"),
        when("lang <> 'fr'", "'We respectfully acknowledges the land.'"),
        when("lang = 'en'", "'We keep employment equity.'"),
        when("doc_id % 5 = 1", "'Decision making'"),
        when("doc_id % 5 = 1", "'* Once more, at the end'"),
    ]
    return out


FOLD = "trim(regexp_replace(coalesce(text, ''), '[^A-Za-z.,]+', ' '{all}))"
GROUP = "case lang when 'es' then null when 'fr' then 'apex' else 'apsa' end"


def forms(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, grp, raw: every document as a form."""
    parts = F.split(F.expr(FOLD.format(all="")), r"\. ?")
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.expr(GROUP).alias("grp"), parts.alias("s"))
    lines = [F.expr(x) for x in _form(lambda k: f"coalesce(trim(get(s, {k - 1})), '')")]
    return docs.select("doc_id", "grp", F.concat_ws("\n", *lines).alias("raw"))


def _head(line: str) -> str:
    bare = rf"upper(regexp_replace(regexp_replace(regexp_replace({line}, '{P.ENUMERATION}', ''), '[:\s]+$', ''), '\s+', ' ', 'g'))"
    return "case " + " ".join(f"when regexp_full_match({bare}, '{p}') then '{name}'" for name, p in P.HEADINGS) + " end"


#: The form, its lines with their sections, logical lines, and records, in DuckDB.
FORMS = rf"""t as (select doc_id, lang, source, {GROUP} as grp, regexp_split_to_array({FOLD.format(all=", 'g'")}, '\. ?') as s from documents),
 raw as (select doc_id, grp, concat_ws(chr(10), {", ".join(_form(lambda k: f"coalesce(trim(s[{k}]), '')"))}) as raw from t),
 ln as (select doc_id, i, trim(x) as line from (select doc_id, unnest(string_split(raw, chr(10))) as x, generate_subscripts(string_split(raw, chr(10)), 1) as i from raw) where trim(x) <> ''),
 hd as (select doc_id, i, line, {_head("line")} as h from ln),
 sec as (select doc_id, i, line, h, coalesce(last_value(h ignore nulls) over (partition by doc_id order by i), 'preamble') as section from hd),
 st as (select *, case when row_number() over (partition by doc_id, section order by i) = 1 or regexp_matches(line, '{P.BULLET}') then 1 else 0 end as begins from sec where h is null),
 gr as (select *, sum(begins) over (partition by doc_id, section order by i) as g from st),
 lg as (select doc_id, section, g, regexp_replace(string_agg(line, ' ' order by i), '{P.BULLET}', '') as item from gr group by 1, 2, 3),
 it as (select doc_id, section, item, row_number() over (partition by doc_id, section order by g) as k from lg where item <> '' and item not like '%:')"""
DUTIES = r"""ro as (select doc_id, g, j, part from (select doc_id, g, unnest(p) as part, generate_subscripts(p, 1) as j from (select doc_id, g, case when length(item) > 200 and len(string_split(item, ';')) > 2 then list_filter(list_transform(string_split(item, ';'), lambda x: trim(x)), lambda x: x <> '') else [item] end as p from lg where section = 'duties'))),
 du as (select doc_id, g, j, trim(regexp_replace(regexp_replace(part, '\(([0-9]{1,3})\s*%\)', '', 'g'), '\s+', ' ', 'g')) as statement, nullif(regexp_extract(part, '\(([0-9]{1,3})\s*%\)', 1), '')::int as share from ro where part not like '%:'),
 dt as (select *, lower(regexp_replace(regexp_extract(statement, '^[^ ]+', 0), '[,.;:]+$', '')) as verb, row_number() over (partition by doc_id order by g, j) as k from du where statement <> '')"""
_DUCK = B.DuckSql()
_SCANNED = "body"
for _p in B.RecordRules().prescribed:
    _SCANNED = f"replace({_SCANNED}, {_DUCK.text(_p)}, ' ')"
RECORDS = rf"""{FORMS}, {DUTIES},
 ls as (select doc_id, section, list(item order by k) as items from it where k <= case section when 'qualifications' then 40 else 20 end group by 1, 2),
 dl as (select doc_id, list(statement order by k) as duties, list(verb order by k) as verbs from dt where k <= 12 group by 1),
 sm as (select doc_id, string_agg(line, ' ' order by i) as summary from st where section = 'summary' group by 1),
 r0 as (select raw.doc_id, grp, raw, lower(regexp_extract(raw, '(?im)^Title:\s*(.*)$', 1)) as title, coalesce(summary, '') as summary, coalesce(duties, []::varchar[]) as duties, coalesce(verbs, []::varchar[]) as verbs,
  coalesce(de.items, []::varchar[]) as decision, coalesce(pr.items, []::varchar[]) as problem, coalesce(re.items, []::varchar[]) as relations, coalesce(qu.items, []::varchar[]) as quals, lower(regexp_replace(raw, '[\x09-\x0D\x20]+', ' ', 'g')) as body
  from raw left join sm using (doc_id) left join dl using (doc_id) left join ls de on de.doc_id = raw.doc_id and de.section = 'decision' left join ls pr on pr.doc_id = raw.doc_id and pr.section = 'problem'
  left join ls re on re.doc_id = raw.doc_id and re.section = 'relationships' left join ls qu on qu.doc_id = raw.doc_id and qu.section = 'qualifications'),
 rec as (select *, {_SCANNED} as scanned, regexp_extract_all(body, '\(([0-9]{{1,3}}) ?%\)', 1) as shares, array_to_string(list_filter(relations, lambda x: not regexp_matches(lower(x), '^(internal|external) connection|^{B.RELATIONS_HEADER}')), ' ') as supervisory,
  list_transform(list_filter(list_transform(quals, lambda x: {B.kind_of(_DUCK, "x")}), lambda y: y in ('knowledge', 'skill', 'ability')), lambda z: case z when 'knowledge' then 0 when 'skill' then 1 else 2 end) as ranks from r0)"""
FOUND = RECORDS + ", f as (" + " union all ".join(f"select doc_id, '{r.rule_id}' as rule_id, '{r.severity}' as severity, unnest({r.found(_DUCK, B.RecordRules())}) as evidence from rec" for r in B.RULES if r.found) + ")"


@register("f13_sections", rf"with {FORMS} select doc_id, section, count(*) filter (where h is null) as n_lines, count(*) filter (where h is not null) as n_headings, coalesce(string_agg(line, chr(10) order by i) filter (where h is null), '') as text from sec group by 1, 2")
def sections(spark: SparkSession, d: str) -> DataFrame:
    """Every section's lines; a heading that comes again goes on with its section."""
    parts = forms(spark, d).select("doc_id", F.explode(P.sections(F.col("raw"))).alias("p")).select("doc_id", "p.*")
    named = parts.groupBy("doc_id", "section").agg(F.flatten(F.collect_list("lines")).alias("x"), F.count(F.lit(1)).alias("n"))  # one document's parts
    return named.select("doc_id", "section", F.size("x").cast("long").alias("n_lines"), F.when(F.col("section") == "preamble", 0).otherwise(F.col("n")).cast("long").alias("n_headings"), F.array_join("x", "\n").alias("text"))


@register("f14_logical_lines", rf"with {FORMS} select doc_id, section, k, item from it")
def logical_lines(spark: SparkSession, d: str) -> DataFrame:
    parts = forms(spark, d).select("doc_id", P.sections(F.col("raw")).alias("p"))
    names = ("preamble", *(n for n, _ in P.HEADINGS))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("section"), P.items(P.section(F.col("p"), n), 1_000_000_000).alias("items")) for n in names])).alias("s")
    return parts.select("doc_id", each).select("doc_id", "s.section", F.posexplode("s.items").alias("k", "item")).withColumn("k", (F.col("k") + 1).cast("long"))


@register("f15_duties", rf"with {FORMS}, {DUTIES} select doc_id, k, verb, statement, share from dt where k <= 12")
def duties(spark: SparkSession, d: str) -> DataFrame:
    """Wrapped bullets joined, run-on lines split, leading verbs and shares of time taken out."""
    own = forms(spark, d).select("doc_id", F.posexplode(P.duties(P.section(P.sections(F.col("raw")), "duties"))).alias("k", "x"))
    return own.select("doc_id", (F.col("k") + 1).cast("long").alias("k"), "x.verb", "x.statement", "x.share")


_MOD = r"nullif(regexp_extract(lower(item), '\b(excellent|working|basic|intermediate|advanced|expert|strong|good)\b', 1), '')"


@register("f15_qualifications", rf"with {FORMS} select doc_id, k, item, {B.kind_of(_DUCK, 'item')} as kind, {_MOD} as modifier from it where section = 'qualifications' and k <= 40")
def qualifications(spark: SparkSession, d: str) -> DataFrame:
    own = forms(spark, d).select("doc_id", F.posexplode(P.items(P.section(P.sections(F.col("raw")), "qualifications"), 40)).alias("k", "item"))
    return own.select("doc_id", (F.col("k") + 1).cast("long").alias("k"), "item", P.qualification_kind(F.col("item")).alias("kind"), P.modifier(F.col("item")).alias("modifier"))


@register("f17_grades", rf"with {FORMS} select doc_id, nullif(regexp_extract(raw, '(?im)^[ \t]*(?:pay )?grade[ \t]*[:#][ \t]*((?:PG[ \t]*)?[0-9]{{1,2}})\b', 1), '') as grade, case when grp in ('apsa', 'apex', 'poly') then grp end as scheme from raw")
def grades(spark: SparkSession, d: str) -> DataFrame:
    return forms(spark, d).select("doc_id", P.grade(F.col("raw")).alias("grade"), F.when(F.col("grp").isin("apsa", "apex", "poly"), F.col("grp")).alias("scheme"))


def _signs(patterns) -> str:
    return " + ".join(f"regexp_matches(lower(raw), '{p}')::int" for p in patterns)


@register(
    "f18_presence",
    rf"""with {FORMS}, lt as (select doc_id, count(*) filter (where regexp_matches(line, '^[A-J][.)]\s+[A-Z]')) as lettered from ln group by 1)
 select raw.doc_id, regexp_matches(lower(raw), 'about us') as about, regexp_matches(lower(raw), '{P.TERRITORIAL}') as territorial, regexp_matches(lower(raw), '{P.EQUITY}') as equity, lettered, {_signs(P.OLD_SIGNS)} + case when lettered >= 3 then 2 else 0 end as old_score, {_signs(P.NEW_SIGNS)} as new_score from raw join lt using (doc_id)""",
)
def presence(spark: SparkSession, d: str) -> DataFrame:
    """Statements that are there, and how many signs of either era a text shows; three lettered headings are two more of the old."""
    low = F.lower("raw")
    lettered = F.size(F.filter(P.lines(F.col("raw")), lambda x: x.rlike(r"^[A-J][.)]\s+[A-Z]")))
    return forms(spark, d).select(
        "doc_id", low.rlike("about us").alias("about"), low.rlike(P.TERRITORIAL).alias("territorial"), low.rlike(P.EQUITY).alias("equity"), lettered.cast("long").alias("lettered"),
        (P.signs(F.col("raw"), P.OLD_SIGNS) + F.when(lettered >= 3, 2).otherwise(0)).alias("old_score"), P.signs(F.col("raw"), P.NEW_SIGNS).alias("new_score"),
    )


def records(spark: SparkSession, d: str) -> DataFrame:
    return B.parsed(forms(spark, d), "raw")


@register("f15_records", rf"with {RECORDS} select doc_id, title, summary, duties, decision, problem, quals, supervisory, len(relations) as n_relations, array_to_string(ranks, ',') as ranks, shares from rec".replace("duties, decision, problem, quals, supervisory", "array_to_string(duties, '|') as duties, array_to_string(decision, '|') as decision, array_to_string(problem, '|') as problem, array_to_string(quals, '|') as quals, supervisory").replace("as ranks, shares from", "as ranks, array_to_string(shares, ',') as shares from"))
def whole_records(spark: SparkSession, d: str) -> DataFrame:
    """The record that all rules read, from one projection."""
    bar = lambda c: F.array_join(c, "|").alias(c)
    return records(spark, d).select("doc_id", "title", "summary", *map(bar, ("duties", "decision", "problem", "quals")), "supervisory", F.size("relations").cast("long").alias("n_relations"), F.array_join(F.col("ranks").cast("array<string>"), ",").alias("ranks"), F.array_join("shares", ",").alias("shares"))


@register("c10_record_findings", f"with {FOUND} select doc_id, rule_id, severity, evidence from f")
def record_findings(spark: SparkSession, d: str) -> DataFrame:
    """All rules of the catalogue that can be evaluated, a row for each finding."""
    return B.findings(records(spark, d), "doc_id")


#: Template, and the rules that don't apply to it.
EXEMPT = (("apex", "STRUCT-DUTIES-TOO-MANY"), ("apex", "AUTH-TITLE-EXEC-DIR"), ("apsa", "COMP-PROBLEM"))


@register("p20_applicable_findings", f"with {FOUND}, x(grp, rule_id) as (values {', '.join(str(e) for e in EXEMPT)}) select coalesce(raw.grp, 'none') as template, f.rule_id, count(*) as n from f join raw using (doc_id) where not exists (select 1 from x where x.grp = raw.grp and x.rule_id = f.rule_id) group by 1, 2")
def applicable(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the rules that apply to a record's template: an anti-join to the catalogue's exemptions."""
    exempt = spark.createDataFrame(EXEMPT, "grp string, rule_id string")
    r = records(spark, d)
    found = B.findings(r.withColumn("key", F.struct("doc_id", "grp")), "key").select("key.doc_id", "key.grp", "rule_id")
    return found.join(F.broadcast(exempt), ["grp", "rule_id"], "left_anti").groupBy(F.coalesce("grp", F.lit("none")).alias("template"), "rule_id").agg(F.count(F.lit(1)).alias("n"))


_PEN = lambda c, b: f"{b} * (1 - pow(0.7, {c})) / 0.3"
_OVER = "case when doc_id % 7 = 0 then [{'gate': 'SUMMARY-LENGTH', 'reason': 'agreed'}, {'gate': 'MANDATORY-SECTIONS', 'reason': 'agreed'}, {'gate': 'EDI-FOOTER', 'reason': 'agreed'}, {'gate': 'GRADE-FLOOR', 'reason': 'agreed'}] when doc_id % 7 = 1 then [{'gate': 'QUAL-EQUIVALENT', 'reason': ' '}] else [] end"
_FAILS = " union all ".join(f"select doc_id, '{g}' as gate from f where rule_id in ({', '.join(repr(r) for r in own)})" for g, _, own in B.GATES)
GATED = f"""{FOUND}, n as (select rec.doc_id, count(*) filter (where severity = 'high') as high, count(*) filter (where severity = 'medium') as medium, count(*) filter (where severity = 'low') as low from rec left join f using (doc_id) group by 1),
 sc as (select *, greatest(0.0, 100.0 - {_PEN('high', 20.0)} - {_PEN('medium', 10.0)} - {_PEN('low', 5.0)}) as score from n),
 gd as (select *, case when score >= 90 then 'A' when score >= 75 then 'B' when score >= 60 then 'C' when score >= 40 then 'D' else 'F' end as grade from sc),
 fl as ({_FAILS} union all select doc_id, 'SEVERITY-FLOOR' from gd where high > 0 union all select doc_id, 'SCORE-FLOOR' from gd where score < 60 union all select doc_id, 'GRADE-FLOOR' from gd where grade in ('D', 'F')),
 ov as (select doc_id, unnest({_OVER}) as o from gd),
 lf as (select distinct doc_id, gate from fl where gate in ({', '.join(repr(x) for x in B.LOCKED)}) or not exists (select 1 from ov where ov.doc_id = fl.doc_id and ov.o.gate = fl.gate and trim(ov.o.reason) <> '')),
 bl as (select doc_id, string_agg(gate, ',' order by gate) as blocking, string_agg(gate, ',' order by gate) filter (where gate in ({', '.join(repr(x) for x in B.LOCKED)})) as locked from lf group by 1)"""


def gate_rows(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    o = lambda g, why="agreed": F.struct(F.lit(g).alias("gate"), F.lit(why).alias("reason"))
    none = F.array().cast("array<struct<gate:string,reason:string>>")
    over = F.when(F.col("doc_id") % 7 == 0, F.array(o("SUMMARY-LENGTH"), o("MANDATORY-SECTIONS"), o("EDI-FOOTER"), o("GRADE-FLOOR"))).when(F.col("doc_id") % 7 == 1, F.array(o("QUAL-EQUIVALENT", " "))).otherwise(none)
    return B.gated(r, B.findings(r, "doc_id"), "doc_id", over)


@register("c11_record_gates", f"with {GATED} select gd.doc_id, round(score + 1e-9, 4) as score, grade, coalesce(blocking, '') as blocking, coalesce(locked, '') as locked, blocking is null as approved from gd left join bl using (doc_id)")
def record_gates(spark: SparkSession, d: str) -> DataFrame:
    """All 14 gates, with overrides by gate and reason; locked ones can't be set aside."""
    return gate_rows(spark, d)


@register("c13_record_baseline", f"with {GATED}, q as (select gd.doc_id, grade, round(score + 1e-9, 4) as score, blocking is null as approved, (select count(*) from f where f.doc_id = gd.doc_id) as issues from gd left join bl using (doc_id)) select coalesce(grp, 'none') as template, grade, count(*) as n, count(*) filter (where approved) as approved, sum(issues)::bigint as issues, round(avg(score), 3) as mean_score from q join raw using (doc_id) group by 1, 2")
def record_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Parse, rules, score and gates of every document, then the segments of the report."""
    r = records(spark, d)
    issues = B.findings(r, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("issues"))
    every = gate_rows(spark, d).join(issues, "doc_id", "left").join(r.select("doc_id", "grp"), "doc_id")
    return every.groupBy(F.coalesce("grp", F.lit("none")).alias("template"), "grade").agg(F.count(F.lit(1)).alias("n"), F.count_if("approved").alias("approved"), F.sum(F.coalesce("issues", F.lit(0))).alias("issues"), F.round(F.avg("score"), 3).alias("mean_score"))
