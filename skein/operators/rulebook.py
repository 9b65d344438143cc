"""Rules as data: each a predicate over a document, a severity, and whether it blocks approval.

Every rule is one element of an array built in a single projection, so a document is read once however
many rules there are. The SQL beside each predicate states the same for a checker.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.config import ScoreConfig
from skein.functions import numbers as N


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    expr: str  # Spark SQL over the row
    sql: str  # the same for DuckDB


def _words(spark: bool) -> str:
    return "size(regexp_extract_all(text, '[^ \\\\t\\\\n\\\\r]+', 0))" if spark else "len(regexp_extract_all(text, '[^ \\t\\n\\r]+'))"


def _both(cond: str) -> tuple[str, str]:
    return cond.replace("WORDS", _words(True)), cond.replace("WORDS", _words(False))


RULES = (
    Rule("COMP-TEXT", "high", *_both("text is null or trim(text) = ''")),
    Rule("COMP-LANG", "medium", *_both("lang is null or lang = ''")),
    Rule("STRUCT-TOO-SHORT", "medium", *_both("WORDS < 20")),
    Rule("STRUCT-TOO-LONG", "low", *_both("WORDS > 5000")),
    Rule("STRUCT-ONE-LINE", "low", "WORDSX >= 100 and not contains(text, '\\n')".replace("WORDSX", _words(True)), f"{_words(False)} >= 100 and not contains(text, chr(10))"),
    Rule("STRUCT-PLACEHOLDER", "medium", *_both("contains(lower(text), 'lorem ipsum') or contains(text, '[insert') or contains(text, '###')")),
    Rule("STRUCT-TABLE", "low", *_both("length(text) - length(replace(text, '|', '')) > 10")),
    Rule("LANG-SYMBOLS", "high", *_both("length(text) - length(replace(replace(replace(text, '$', ''), '%', ''), '&', '')) > 30")),
    Rule("LANG-SHOUTING", "medium", *_both("length(text) - length(replace(text, '!', '')) > 20")),
    Rule("LANG-CODED", "low", *_both("contains(lower(text), 'stupid') or contains(lower(text), 'idiot') or contains(lower(text), 'scum')")),
    Rule("QUAL-SECRET", "high", *_both("contains(text, 'token = ')")),
    Rule("QUAL-CONTACT", "medium", *_both("contains(text, '@mail')")),
    Rule("AUTH-LICENSE", "info", *_both("contains(text, 'icensed under')")),
    Rule("GATE-DIGITS", "low", *_both("length(text) - length(replace(replace(replace(text, '1', ''), '2', ''), '3', '')) > 12")),
)
#: Rules that block approval whatever the score.
BLOCKING = ("COMP-TEXT", "QUAL-SECRET", "STRUCT-PLACEHOLDER")
SCORE_FLOOR, GRADE_FLOOR = 60.0, ("D", "F")


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r.rule_id, r.severity, r.rule_id in BLOCKING) for r in RULES], "rule_id string, severity string, blocking boolean")


def evaluated(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``found``: an array of (rule_id, severity) of the rules that hold; unknown doesn't hold."""
    each = [F.when(F.expr(r.expr), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"))) for r in rules]
    return docs.withColumn("found", F.filter(F.array(*each), lambda x: x.isNotNull()))


def findings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each rule that holds for a document."""
    return evaluated(docs, rules).select("doc_id", F.explode("found").alias("x")).select("doc_id", "x.rule_id", "x.severity")


def counted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of each document by severity, without a shuffle: sizes of filtered arrays."""
    n = lambda s: F.size(F.filter("found", lambda x: x["severity"] == s)).cast("long").alias(s)
    return evaluated(docs, rules).select("doc_id", "lang", "source", "n_chars", n("high"), n("medium"), n("low"))


def scored(docs: DataFrame, cfg: ScoreConfig = ScoreConfig()) -> DataFrame:
    s = counted(docs).withColumn("score", N.score(F.col("high"), F.col("medium"), F.col("low"), cfg))
    return s.withColumn("grade", N.grade(F.col("score"), cfg))


def blocked(scores: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, gate of every gate that a document fails: blocking rules, then the severity, score and grade floors."""
    rules = found.filter(F.col("rule_id").isin(*BLOCKING)).select("doc_id", F.concat(F.lit("BLOCKING:"), "rule_id").alias("gate"))
    floors = F.array(
        F.when(F.col("high") > 0, "SEVERITY-FLOOR"),
        F.when((F.col("score") < SCORE_FLOOR) | F.isnan("score"), "SCORE-FLOOR"),
        F.when(F.col("grade").isin(*GRADE_FLOOR), "GRADE-FLOOR"),
    )
    return rules.unionByName(scores.select("doc_id", F.explode(F.filter(floors, lambda x: x.isNotNull())).alias("gate"))).distinct()


def gated(scores: DataFrame, found: DataFrame, overrides: Column | None = None) -> DataFrame:
    """doc_id, blocking (gates joined by commas), approved. ``overrides``: gates set aside, as an array of names."""
    b = blocked(scores, found)
    b = b if overrides is None else b.filter(~F.array_contains(overrides, F.col("gate")))
    each = b.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("gate")), ",").alias("blocking"))
    return scores.select("doc_id").join(each, "doc_id", "left").select("doc_id", F.coalesce("blocking", F.lit("")).alias("blocking"), F.col("blocking").isNull().alias("approved"))
