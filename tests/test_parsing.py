"""Parsing of hand-written records, and each rule on a record that breaks only it."""

from pyspark.sql import functions as F

from skein.functions import parsing as P
from skein.operators import records as B

GOOD = """Title: Analyst
Pay grade: 7

POSITION SUMMARY
{summary}
Duties and Responsibilities:
- Manages the flow of water (50%)
  across the town
- Leads the work (30%)
- Plans; or not (20%)
Impact of Decision-Making
* Decides on pipes
2. Problem Solving and Level of Supervision
* Solves leaks
RELATIONSHIPS
Establishes and maintains relationships and alliances
Supervisory: two clerks
Qualifications
* Excellent knowledge of water
* Advanced skills in pipes
* Ability to listen
* Five years of experience, or an equivalent combination
Additional Information
About us: a compassionate community.
We respectfully acknowledges the land, and keep employment equity.
"""
TEXT = GOOD.format(summary=" ".join(["water"] * 120))


def found(spark, *texts):
    df = spark.createDataFrame([(i, t, "apsa") for i, t in enumerate(texts)], "doc_id long, raw string, grp string")
    out = {i: set() for i in range(len(texts))}
    for r in B.findings(B.parsed(df, "raw"), "doc_id").collect():
        out[r.doc_id].add(r.rule_id)
    return list(out.values())


def test_a_record_is_parsed(spark):
    df = spark.createDataFrame([(1, TEXT, "apsa"), (2, None, None), (3, "no form at all\n\n", None)], "doc_id long, raw string, grp string")
    r = {x.doc_id: x for x in B.parsed(df, "raw").withColumn("g", P.grade(F.col("raw"))).collect()}
    assert r[1].title == "analyst" and r[1].g == "7" and r[1].duties == ["Manages the flow of water across the town", "Leads the work", "Plans; or not"]
    assert r[1].verbs == ["manages", "leads", "plans"] and r[1].shares == ["50", "30", "20"] and r[1].decision == ["Decides on pipes"] and r[1].problem == ["Solves leaks"]
    assert r[1].ranks == [0, 1, 2, 2] or r[1].ranks == [0, 1, 2]
    assert r[2].duties == [] and r[2].summary == "" and r[3].quals == [] and r[3].g is None


def test_each_rule_on_a_record_that_breaks_it(spark):
    cases = {
        "": TEXT,
        "COMP-ABOUT": TEXT.replace("About us: a compassionate community.", ""),
        "COMP-TERRITORIAL": TEXT.replace("respectfully acknowledges", "likes"),
        "COMP-EDI": TEXT.replace("employment equity", "order"),
        "COMP-DECISION": TEXT.replace("* Decides on pipes\n", ""),
        "STRUCT-SUMMARY-TOO-SHORT": GOOD.format(summary="water " * 20),
        "STRUCT-SUMMARY-TOO-LONG": GOOD.format(summary="water " * 151),
        "STRUCT-DUTIES-TOO-MANY": TEXT.replace("- Plans; or not (20%)", "- Plans (20%)\n- Plans a\n- Plans b\n- Plans c"),
        "STRUCT-ACTION-VERB": TEXT.replace("Leads the work", "The work"),
        "STRUCT-PLACEHOLDER": TEXT.replace("the town", "the town [insert more]"),
        "QUAL-SKILL-MODIFIER": TEXT.replace("Advanced skills", "Skills"),
        "QUAL-MODIFIER-VOCAB": TEXT.replace("Advanced skills", "Strong skills"),
        "QUAL-EQUIVALENT": TEXT.replace(", or an equivalent combination", ""),
        "QUAL-BANNED-PHRASE": TEXT.replace("of experience", "of experience, which may include travel"),
        "QUAL-DEGREE-DISCIPLINE": TEXT.replace("Five years", "A degree, five years"),
        "LANG-CODED": TEXT.replace("two clerks", "two clerks and the chairman"),
        "GATE-DUTY-PCT": TEXT.replace("(20%)", "(40%)"),
        "GATE-KSA-ORDER": TEXT.replace("* Excellent knowledge of water\n", "").replace("* Ability to listen", "* Ability to listen\n* Excellent knowledge of water"),
        "GATE-SENIOR-TITLE": TEXT.replace("Title: Analyst", "Title: Senior Analyst").replace("Supervisory: two clerks\n", ""),
        "GATE-REL-HEADER": TEXT.replace("Establishes and maintains relationships and alliances", "Knows people"),
        "AUTH-SUMMARY-CONDITIONS": GOOD.format(summary="water " * 110 + "on call"),
        "AUTH-SUMMARY-INCUMBENT": GOOD.format(summary="water " * 110 + "in my town"),
        "AUTH-ABILITIES-OBSERVABLE": TEXT.replace("* Ability to listen", "* Shows ability"),
        "AUTH-TITLE-EXEC-DIR": TEXT.replace("Title: Analyst", "Title: Executive Director"),
        "AUTH-TITLE-REGISTRAR": TEXT.replace("Title: Analyst", "Title: Registrar"),
        "AUTH-TITLE-HR": TEXT.replace("Title: Analyst", "Title: Human Resources clerk"),
    }
    for (rule, _), got in zip(cases.items(), found(spark, *cases.values()), strict=True):
        assert got == ({rule} if rule else set()), (rule, got)
    (bare,) = found(spark, "Title: x")
    assert {"COMP-SUMMARY", "COMP-DUTIES", "COMP-QUALS", "COMP-PROBLEM", "COMP-RELATIONSHIPS"} <= bare


def test_the_catalogue_is_whole():
    assert len({r.rule_id for r in B.RULES}) == 32 and [r.rule_id for r in B.RULES if r.found is None] == ["STRUCT-HOW-WHY"]
    assert len(B.GATES) + 3 == 14 and B.LOCKED == ("MANDATORY-SECTIONS", "NO-PLACEHOLDERS")


def test_locked_gates_stay(spark):
    df = spark.createDataFrame([(1, "Title: x", None)], "doc_id long, raw string, grp string")
    r = B.parsed(df, "raw")
    every = F.array(*[F.struct(F.lit(g).alias("gate"), F.lit("because").alias("reason")) for g in [*[g for g, _, _ in B.GATES], "SEVERITY-FLOOR", "SCORE-FLOOR", "GRADE-FLOOR"]])
    got = B.gated(r, B.findings(r, "doc_id"), "doc_id", every).first()
    assert got.blocking == got.locked == "MANDATORY-SECTIONS" and not got.approved
