"""Quality rules: one table of thresholds compiled into one projection, with built-in functions only.

Null texts count as empty. A text without words has zero in every count and ratio and fails the
rule on words. Ties, repeated rows and extra columns have no effect: each row is judged alone, and
a column of the input that bears the name of a result is left out unless it is ``doc_id``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: White space that ends a word, and the characters that count as symbols.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Function words of the languages at hand; running text holds some of them.
STOP_WORDS = (
    "the be to of and that have with a in is it for on as was by at from or an "
    "le la les de des et un une est que qui dans pour par sur avec au du en ce "
    "der die das und zu den von mit auf ist ein eine für als auch nicht im sich "
    "el los las que y del se por con una para su es lo al como más"
).split()


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie within [low, high]; None leaves a side open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The production table. Ratios are per word unless the name says otherwise.
RULES = (
    Rule("words", "n_words", 10, None),
    Rule("repeats", "repeat_ratio", None, 0.20),
    Rule("word_length", "mean_word_chars", 1.5, 14.0),
    Rule("symbols", "symbol_ratio", None, 0.30),
    Rule("pipes", "pipe_line_ratio", None, 0.50),
    Rule("stop_words", "stop_ratio", 0.02, None),
    Rule("dup_lines", "dup_line_ratio", None, 0.50),
    Rule("capitals", "shout_ratio", None, 0.60),
    Rule("same_words", "stutter_ratio", None, 0.40),
)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once (a lambda variable is a value, not an expression)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def repeated_words(words: Column, n: int = 5) -> Column:
    """How many words lie in an ``n``-word window that the text holds twice or more.

    Windows are compared by 64-bit hashes. Positions are sorted with the hashes only where some
    window repeats, so that most texts pay for one sort of longs.
    """

    def covered(s: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(s, j)["h"] == F.get(s, i)["h"], F.lit(False))
        hit = F.filter(s, lambda e, i: F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)))
        return let(
            F.sort_array(F.transform(hit, lambda e: e["i"])),
            lambda p: F.aggregate(
                F.transform(p, lambda x, i: F.least(F.lit(n), F.coalesce(F.get(p, i + 1), x + n) - x)),
                F.lit(0),
                lambda a, x: a + x,
            ),
        )

    def windows(h: Column) -> Column:
        grams = F.transform(
            F.slice(h, 1, F.greatest(F.size(h) - (n - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, n)]),
        )
        return let(
            grams,
            lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(
                let(F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered)
            ),
        )

    return let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with a struct ``_m`` of counts and ratios of each text."""
    t = F.coalesce(df[text], F.lit(""))
    letters = F.length(F.regexp_replace(t, r"[^A-Za-z]+", ""))
    first = df.withColumns({"_skein_t": t, "_skein_w": words_of(df[text]), "_skein_l": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    counted = first.withColumn(
        "_skein_c",
        F.struct(
            F.size("_skein_w").cast("long").alias("n_words"),
            F.length(F.array_join("_skein_w", "")).cast("long").alias("word_chars"),
            F.regexp_count("_skein_t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
            (F.size("_skein_l") - F.size(F.array_distinct("_skein_l"))).cast("long").alias("n_dup_lines"),
            repeated_words(F.col("_skein_w")).cast("long").alias("n_repeat_words"),
            F.size("_skein_l").alias("n_lines"),
            F.size(F.filter("_skein_l", lambda x: F.regexp_count(x, F.lit(r"\|")) >= 2)).alias("n_pipe_lines"),
            F.size(F.filter("_skein_w", lambda w: w.isin(STOP_WORDS) | F.lower(w).isin(STOP_WORDS))).alias("n_stop"),
            letters.alias("n_letters"),
            F.length(F.regexp_replace("_skein_t", r"[^A-Z]+", "")).alias("n_capitals"),
            let(F.col("_skein_w"), lambda w: F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False))))).alias("n_stutter"),
        ),
    )
    c = lambda k: F.col(f"_skein_c.{k}")
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return counted.withColumn(
        "_m",
        F.struct(
            F.col("_skein_c.*"),
            per(c("n_repeat_words"), c("n_words")).alias("repeat_ratio"),
            per(c("word_chars"), c("n_words")).alias("mean_word_chars"),
            per(c("n_symbols"), c("n_words")).alias("symbol_ratio"),
            per(c("n_pipe_lines"), c("n_lines")).alias("pipe_line_ratio"),
            # a text of under 30 words is too short to tell
            F.when(c("n_words") < 30, F.lit(1.0)).otherwise(per(c("n_stop"), c("n_words"))).alias("stop_ratio"),
            per(c("n_dup_lines"), c("n_lines")).alias("dup_line_ratio"),
            per(c("n_capitals"), c("n_letters")).alias("shout_ratio"),
            per(c("n_stutter"), c("n_words")).alias("stutter_ratio"),
        ),
    ).drop("_skein_t", "_skein_w", "_skein_l", "_skein_c")


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row of :func:`measures` breaks, as an array."""
    broken = []
    for r in rules:
        m = F.col(f"_m.{r.measure}")
        bad = F.lit(False)
        bad = bad | (m < r.low) if r.low is not None else bad
        bad = bad | (m > r.high) if r.high is not None else bad
        broken.append(F.when(bad, F.lit(r.name)))
    return F.filter(F.array(*broken), lambda x: x.isNotNull())


def apply_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``df`` with ``_m`` (measures), ``broken`` (rule names) and ``kept`` (none broken)."""
    base = df.drop("broken", "kept", "_m")
    return measures(base, text).withColumn("broken", compiled(rules)).withColumn("kept", F.size("broken") == 0)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_rules(docs)
    n, rep = F.col("_m.n_words"), F.col("_m.n_repeat_words")
    failed = (n < 10) | (100 * rep > 20 * n)
    return out.select(
        "doc_id",
        n.alias("n_words"),
        F.col("_m.word_chars").alias("word_chars"),
        F.col("_m.n_symbols").alias("n_symbols"),
        F.col("_m.n_dup_lines").alias("n_dup_lines"),
        rep.alias("n_repeat_words"),
        failed.alias("base_failed"),
        (F.col("kept") & ~failed).alias("kept"),
    )


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for the rows of op5, from the same table of rules."""
    space = r"[\x20\x09-\x0D]"
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    per = lambda a, b: f"case when {b} > 0 then {a} / {b} else 0.0 end"
    sides = [f"{r.measure} >= {r.low}" for r in rules if r.low is not None] + [f"{r.measure} <= {r.high}" for r in rules if r.high is not None]
    return f"""with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
 w as (select rid, doc_id, t, list_filter(regexp_split_to_array(t, '{space}+'), lambda x: x <> '') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from t),
 g as (select rid, i, array_to_string(w[i:i+4], chr(1)) as gram from (select rid, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)),
 d as (select rid, gram from g group by 1, 2 having count(*) > 1),
 c as (select rid, count(distinct p)::bigint as n from (select rid, unnest(range(i, i + 5)) as p from g join d using (rid, gram)) group by 1),
 m as (select rid, doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, len(regexp_extract_all(t, '[{SYMBOLS}]')) as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words,
  len(l) as n_lines, len(list_filter(l, lambda x: len(regexp_extract_all(x, '[|]')) >= 2)) as n_pipe_lines, len(list_filter(w, lambda x: x in ({stop}) or lower(x) in ({stop}))) as n_stop,
  length(regexp_replace(t, '[^A-Za-z]+', '', 'g')) as n_letters, length(regexp_replace(t, '[^A-Z]+', '', 'g')) as n_capitals, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as n_stutter from w left join c using (rid)),
 r as (select *, {per("n_repeat_words", "n_words")} as repeat_ratio, {per("word_chars", "n_words")} as mean_word_chars, {per("n_symbols", "n_words")} as symbol_ratio, {per("n_pipe_lines", "n_lines")} as pipe_line_ratio,
  case when n_words < 30 then 1.0 else {per("n_stop", "n_words")} end as stop_ratio, {per("n_dup_lines", "n_lines")} as dup_line_ratio, {per("n_capitals", "n_letters")} as shout_ratio, {per("n_stutter", "n_words")} as stutter_ratio,
  n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
 select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {" and ".join(sides)} as kept from r"""
