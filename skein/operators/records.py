"""Rules over parsed records, each a list of what it found, and gates over the findings.

A rule is stated once for two engines: its predicate takes a dialect and gives the expression, so that the
checker's SQL and the plan can't drift apart. All rules of a record are elements of one array in one
projection: a record is read once, and nothing is shuffled until findings are counted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.config import ScoreConfig
from skein.functions import numbers as N
from skein.functions import parsing as P

# ---- fixed values of the rules --------------------------------------------------------------------
PLACEHOLDERS = ("action verb", "how and why", "what by", "spell out acronyms", "provide a high level summary", "____", "[insert")
CONDITIONS = ("on-call", "on call", "shift work", "evenings and weekends", "evening and weekend", "weekends and holidays", "standby", "stand-by", "housing", "parking", "relocation")
RELATIONS_HEADER = "establishes and maintains relationships and alliances"
EQUIVALENT = "equivalent combination"
BANNED = ("may include", "assets", "preferences")
SKILL_MODIFIERS, KNOWLEDGE_MODIFIERS = ("basic", "intermediate", "advanced", "expert"), ("excellent", "working", "none")
SUMMARY_WORDS, DUTIES, SHARES = (100, 150), (3, 5), (99, 101)
CODED_MEDIUM = (
    "aggressive", "ambitious", "championing", "competitive", "confidential", "dominant", "foreman", "persistent", "compassionate", "agreement", "in-kind", "rockstar", "ninja", "guru", "chairman", "policeman",
    "fireman", "salesman", "businessman", "spokesman", "craftsman", "workman", "middleman", "repairman", "waitress", "actress", "stewardess", "manpower", "man-hours", "mankind", "manmade",
)
CODED_LOW = ("individual", "honest", "trust", "he/she", "s/he", "his/her")


@dataclass(frozen=True)
class RecordRules:
    """What an organisation sets itself: verbs that may lead a duty, passages it prescribes, the group that a title is for."""

    verbs: tuple[str, ...] = ("manages", "leads", "plans", "develops", "provides", "coordinates", "maintains", "advises", "reviews", "prepares")
    prescribed: tuple[str, ...] = ("about us: a compassionate community.",)
    director_group: str = "apex"


class SparkSql:
    empty = "cast(array() as array<string>)"

    def text(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def has(self, c: str, pattern: str) -> str:
        return f"({c} rlike {self.text(pattern)})"

    def size(self, x: str) -> str:
        return f"size({x})"

    def where(self, x: str, cond: str) -> str:
        return f"filter({x}, x -> {cond})"

    def each(self, x: str, e: str) -> str:
        return f"transform({x}, x -> {e})"

    def all_of(self, c: str, pattern: str) -> str:
        return f"regexp_extract_all({c}, {self.text(pattern)}, 1)"

    def total(self, x: str) -> str:
        return f"aggregate({x}, 0, (a, x) -> a + cast(x as int))"

    def sorted(self, x: str) -> str:
        return f"array_sort({x})"

    def array(self, *x: str) -> str:
        return f"array({', '.join(x)})" if x else self.empty

    def joined(self, x: str) -> str:
        return f"array_join({x}, ' ')"


class DuckSql(SparkSql):
    empty = "[]::varchar[]"

    def text(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def has(self, c: str, pattern: str) -> str:
        return f"regexp_matches({c}, {self.text(pattern)})"

    def size(self, x: str) -> str:
        return f"len({x})"

    def where(self, x: str, cond: str) -> str:
        return f"list_filter({x}, lambda x: {cond})"

    def each(self, x: str, e: str) -> str:
        return f"list_transform({x}, lambda x: {e})"

    def total(self, x: str) -> str:
        return f"coalesce(list_sum(list_transform({x}, lambda x: x::int)), 0)"

    def sorted(self, x: str) -> str:
        return f"list_sort({x})"

    def array(self, *x: str) -> str:
        return f"[{', '.join(x)}]" if x else self.empty

    def joined(self, x: str) -> str:
        return f"array_to_string({x}, ' ')"


def kind_of(q: SparkSql, x: str) -> str:
    return "case " + " ".join(f"when {q.has(f'lower({x})', p)} then '{k}'" for k, p in P.KINDS) + " else 'ability' end"


def _one(q: SparkSql, cond: str) -> str:
    return f"case when {cond} then {q.array(q.text(''))} else {q.empty} end"


def _terms(q: SparkSql, terms: tuple[str, ...], text: str) -> str:
    """The terms that stand in a text as words of their own."""
    word = q.has(text, "(^|[^a-z0-9])TERM([^a-z0-9]|$)").replace("TERM", "' || x || '")
    return q.where(q.array(*map(q.text, terms)), f"contains({text}, x) and {word}")


def _any(q: SparkSql, terms: tuple[str, ...], text: str) -> str:
    return "(" + " or ".join(f"contains({text}, {q.text(t)})" for t in terms) + ")"


def _quals(q: SparkSql, kind: str) -> str:
    return q.where("quals", f"{kind_of(q, 'x')} = '{kind}'")


def _modifier(q: SparkSql, x: str) -> str:
    return f"regexp_extract(lower({x}), {q.text(chr(92) + 'b(excellent|working|basic|intermediate|advanced|expert|strong|good)' + chr(92) + 'b')}, 1)"


def _off(q: SparkSql, kind: str, allowed: tuple[str, ...]) -> str:
    names = ", ".join(f"'{a}'" for a in ("", *allowed))
    return f"{q.size(q.where(_quals(q, kind), f'{_modifier(q, "x")} not in ({names})'))} > 0"


def _words(q: SparkSql) -> str:
    return q.size("regexp_extract_all(summary, '[^ ]+', 0)")


@dataclass(frozen=True)
class RecordRule:
    """``found`` gives the list of what the rule found as an expression; None is catalogued but can't be evaluated."""

    rule_id: str
    severity: str
    found: Callable[[SparkSql, RecordRules], str] | None


def _rule(rule_id: str, severity: str, cond: Callable[[SparkSql, RecordRules], str]) -> RecordRule:
    return RecordRule(rule_id, severity, lambda q, r: _one(q, cond(q, r)))


RULES = (
    _rule("COMP-SUMMARY", "high", lambda q, r: "summary = ''"),
    _rule("COMP-DUTIES", "high", lambda q, r: f"{q.size('duties')} = 0"),
    _rule("COMP-DECISION", "medium", lambda q, r: f"{q.size('decision')} = 0"),
    _rule("COMP-PROBLEM", "medium", lambda q, r: f"{q.size('problem')} = 0"),
    _rule("COMP-RELATIONSHIPS", "low", lambda q, r: f"{q.size('relations')} = 0"),
    _rule("COMP-QUALS", "high", lambda q, r: f"{q.size('quals')} = 0"),
    _rule("COMP-ABOUT", "low", lambda q, r: f"not {q.has('body', 'about us')}"),
    _rule("COMP-TERRITORIAL", "low", lambda q, r: f"not {q.has('body', P.TERRITORIAL)}"),
    _rule("COMP-EDI", "low", lambda q, r: f"not {q.has('body', P.EQUITY)}"),
    _rule("STRUCT-SUMMARY-TOO-SHORT", "low", lambda q, r: f"summary <> '' and {_words(q)} < {SUMMARY_WORDS[0]}"),
    _rule("STRUCT-SUMMARY-TOO-LONG", "low", lambda q, r: f"{_words(q)} > {SUMMARY_WORDS[1]}"),
    _rule("STRUCT-DUTIES-TOO-FEW", "medium", lambda q, r: f"{q.size('duties')} > 0 and {q.size('duties')} < {DUTIES[0]}"),
    _rule("STRUCT-DUTIES-TOO-MANY", "medium", lambda q, r: f"{q.size('duties')} > {DUTIES[1]}"),
    _rule("STRUCT-ACTION-VERB", "low", lambda q, r: f"{q.size(q.where('verbs', 'x not in (' + ', '.join(map(q.text, r.verbs)) + ')'))} > 0"),
    RecordRule("STRUCT-HOW-WHY", "low", None),
    _rule("STRUCT-PLACEHOLDER", "medium", lambda q, r: _any(q, PLACEHOLDERS, "body")),
    _rule("QUAL-SKILL-MODIFIER", "low", lambda q, r: f"{q.size(q.where(_quals(q, 'skill'), _modifier(q, 'x') + chr(32) + '= ' + q.text('')))} > 0"),
    _rule("QUAL-MODIFIER-VOCAB", "low", lambda q, r: f"{_off(q, 'skill', SKILL_MODIFIERS)} or {_off(q, 'knowledge', KNOWLEDGE_MODIFIERS)}"),
    _rule("QUAL-EQUIVALENT", "low", lambda q, r: f"not contains(body, '{EQUIVALENT}')"),
    RecordRule("QUAL-BANNED-PHRASE", "medium", lambda q, r: _terms(q, BANNED, f"lower({q.joined('quals')})")),
    _rule("QUAL-DEGREE-DISCIPLINE", "low", lambda q, r: f"{q.has('body', chr(92) + 'b(bachelor|master|phd|doctorate|degree)' + chr(92) + 'b')} and not {q.has('body', '(related|relevant) +(discipline|field)|or +other +relevant')}"),
    RecordRule("LANG-CODED", "medium", lambda q, r: _terms(q, CODED_MEDIUM, "scanned")),
    RecordRule("LANG-CODED", "low", lambda q, r: _terms(q, CODED_LOW, "scanned")),
    _rule("GATE-DUTY-PCT", "medium", lambda q, r: f"{q.size('shares')} >= 2 and {q.total('shares')} not between {SHARES[0]} and {SHARES[1]}"),
    _rule("GATE-KSA-ORDER", "low", lambda q, r: f"{q.sorted('ranks')} <> ranks"),
    _rule("GATE-SENIOR-TITLE", "low", lambda q, r: f"{q.has('title', chr(92) + 'bsenior' + chr(92) + 'b')} and supervisory = ''"),
    _rule("GATE-REL-HEADER", "low", lambda q, r: f"not contains(body, '{RELATIONS_HEADER}')"),
    _rule("AUTH-SUMMARY-CONDITIONS", "medium", lambda q, r: _any(q, CONDITIONS, "lower(summary)")),
    _rule("AUTH-SUMMARY-INCUMBENT", "low", lambda q, r: q.has("lower(summary)", r"\bmy\b|\bmyself\b|\bi am\b")),
    _rule("AUTH-ABILITIES-OBSERVABLE", "low", lambda q, r: f"{q.size(q.where(_quals(q, 'ability'), 'not (' + q.has('lower(x)', '^(ability to|able to)') + ')'))} > 0"),
    _rule("AUTH-TITLE-EXEC-DIR", "low", lambda q, r: f"contains(title, 'executive director') and grp is not null and grp <> '{r.director_group}'"),
    _rule("AUTH-TITLE-REGISTRAR", "info", lambda q, r: "contains(title, 'registrar')"),
    _rule("AUTH-TITLE-HR", "info", lambda q, r: "contains(title, 'human resources')"),
)
#: Gates by rules, and whether one with a reason may set them aside. The three floors can be.
GATES = (
    ("MANDATORY-SECTIONS", False, ("COMP-SUMMARY", "COMP-DUTIES", "COMP-QUALS")),
    ("NO-PLACEHOLDERS", False, ("STRUCT-PLACEHOLDER",)),
    ("DUTY-ALLOCATION", True, ("GATE-DUTY-PCT",)),
    ("QUAL-MINIMUM", True, ("QUAL-BANNED-PHRASE",)),
    ("EDI-FOOTER", True, ("COMP-TERRITORIAL", "COMP-EDI")),
    ("SUMMARY-CONDITIONS", True, ("AUTH-SUMMARY-CONDITIONS",)),
    ("SUMMARY-INCUMBENT", True, ("AUTH-SUMMARY-INCUMBENT",)),
    ("SUMMARY-LENGTH", True, ("STRUCT-SUMMARY-TOO-LONG",)),
    ("KSA-ORDER", True, ("GATE-KSA-ORDER",)),
    ("QUAL-EQUIVALENT", True, ("QUAL-EQUIVALENT",)),
    ("SENIOR-TITLE", True, ("GATE-SENIOR-TITLE",)),
)
SCORE_FLOOR, LOW_GRADES = 60.0, ("D", "F")
LOCKED = tuple(g for g, free, _ in GATES if not free)


def parsed(docs: DataFrame, raw: str, rules: RecordRules = RecordRules()) -> DataFrame:
    """``docs`` with the fields of the record in its column ``raw``, as the rules read them."""
    d = docs.withColumn("_s", P.sections(F.col(raw)))
    own = lambda name, most=20: P.items(P.section(F.col("_s"), name), most)
    field = lambda label: F.regexp_extract(F.array_join(P.section(F.col("_s"), "preamble"), "\n"), rf"(?im)^{label}:\s*(.*)$", 1)
    body = F.lower(F.regexp_replace(F.col(raw), r"[\x09-\x0D\x20]+", " "))
    scanned = body
    for passage in rules.prescribed:
        scanned = F.replace(scanned, F.lit(passage), F.lit(" "))
    d = d.withColumns({"_d": P.duties(P.section(F.col("_s"), "duties")), "quals": own("qualifications", 40), "relations": own("relationships")})
    kinds = F.filter(F.transform("quals", P.qualification_kind), lambda k: k.isin("knowledge", "skill", "ability"))
    return d.withColumns(
        {
            "title": F.lower(field("Title")),
            "summary": F.array_join(P.section(F.col("_s"), "summary"), " "),
            "duties": F.transform("_d", lambda x: x["statement"]),
            "verbs": F.transform("_d", lambda x: x["verb"]),
            "shares": F.regexp_extract_all(body, F.lit(r"\(([0-9]{1,3}) ?%\)"), 1),
            "decision": own("decision"),
            "problem": own("problem"),
            "supervisory": F.array_join(F.filter("relations", lambda x: ~F.lower(x).rlike("^(internal|external) connection|^" + RELATIONS_HEADER)), " "),
            "ranks": F.transform(kinds, lambda k: F.when(k == "knowledge", 0).when(k == "skill", 1).otherwise(2)),
            "body": body,
            "scanned": scanned,
        }
    ).drop("_s", "_d")


def findings(records: DataFrame, key: str, rules: RecordRules = RecordRules(), catalogue: tuple[RecordRule, ...] = RULES) -> DataFrame:
    """key, rule_id, severity, evidence: a row for each thing that a rule found."""
    q = SparkSql()
    each = [F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.expr(r.found(q, rules)).alias("found")) for r in catalogue if r.found]
    some = records.select(key, F.explode(F.filter(F.array(*each), lambda x: F.size(x["found"]) > 0)).alias("x"))
    return some.select(key, "x.rule_id", "x.severity", F.explode("x.found").alias("evidence"))


def gated(records: DataFrame, found: DataFrame, key: str, overrides: Column, cfg: ScoreConfig = ScoreConfig()) -> DataFrame:
    """key, score, grade, blocking and locked (gates, comma-joined), approved, for every record.

    ``overrides`` is an array of (gate, reason); one without a reason counts for nothing, and locked gates
    stay whatever it says. A score that isn't a number fails its floor.
    """
    n = lambda s: F.count_if(F.col("severity") == s).alias(s)
    counts = found.groupBy(key).agg(n("high"), n("medium"), n("low"), F.collect_set("rule_id").alias("rules"))  # as many as there are rules
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    all_ = records.select(key, overrides.alias("_o")).join(counts, key, "left")
    all_ = all_.withColumn("score", N.score(zero("high"), zero("medium"), zero("low"), cfg)).withColumn("grade", N.grade(F.col("score"), cfg))
    rules = F.coalesce("rules", F.array().cast("array<string>"))
    failed = [F.when(F.arrays_overlap(rules, F.array(*map(F.lit, own))), gate) for gate, _, own in GATES]
    failed += [F.when(zero("high") > 0, "SEVERITY-FLOOR"), F.when(~(F.col("score") >= SCORE_FLOOR) | F.isnan("score"), "SCORE-FLOOR"), F.when(F.col("grade").isin(*LOW_GRADES), "GRADE-FLOOR")]
    waived = lambda g: F.exists("_o", lambda o: (o["gate"] == g) & (F.trim(o["reason"]) != "")) & ~g.isin(*LOCKED)
    left = F.array_sort(F.filter(F.array(*failed), lambda g: g.isNotNull() & ~F.coalesce(waived(g), F.lit(False))))
    out = all_.withColumn("_b", left)
    return out.select(key, F.round(F.col("score") + 1e-9, 4).alias("score"), "grade", F.array_join("_b", ",").alias("blocking"), F.array_join(F.filter("_b", lambda g: g.isin(*LOCKED)), ",").alias("locked"), (F.size("_b") == 0).alias("approved"))
