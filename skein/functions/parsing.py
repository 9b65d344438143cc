"""Structured records out of plain text: headings, sections, logical lines, duties, qualifications, presence, grades.

All builders are columns over one row's text, so a document is parsed where it is read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: The headings of each section, matched whole and in this order, whatever their case.
HEADINGS = (
    ("identification", "IDENTIFICATION( SECTION)?|POSITION IDENTIFICATION"),
    ("summary", "POSITION SUMMARY|SUMMARY OF RESPONSIBILITY( LEVEL)?|JOB SUMMARY|SUMMARY"),
    ("duties", "DUTIES( AND| &)? RESPONSIBILITIES|TYPICAL DUTIES|KEY DUTIES|PRIMARY FUNCTIONS|DUTIES"),
    ("decision", "IMPACT OF DECISION[ -]?MAKING|DECISION[ -]?MAKING"),
    ("problem", "PROBLEM[ -]?SOLVING( AND LEVEL OF SUPERVISION)?"),
    ("relationships", "RELATIONSHIPS|PRIMARY WORKING RELATIONSHIPS|SUPERVISION RECEIVED|SUPERVISION EXERCISED|CONTACTS"),
    ("qualifications", "MINIMUM ENTRANCE QUALIFICATIONS|MINIMUM QUALIFICATIONS|QUALIFICATIONS|EDUCATION AND EXPERIENCE"),
    ("footer", "TERRITORIAL ACKNOWLEDGE?MENT( AND EDI COMMITMENT)?|EDI COMMITMENT|EMPLOYMENT EQUITY"),
    ("context", "ADDITIONAL CONTEXT(UAL INFORMATION)?|ADDITIONAL INFORMATION"),
)
#: What tells the kind of a qualification, in this order; anything else is an ability.
KINDS = (
    ("knowledge", r"\bknowledge\b"),
    ("skill", r"\bskills?\b|\bproficien"),
    ("ability", r"\bability\b|\bable to\b"),
    ("education", r"\bdegree\b|\bdiploma\b|bachelor|master|ph\.?d|doctorate|\beducation\b|certification|designation"),
    ("experience", r"\bexperience\b|\byears?\b"),
)
#: Signs of a statement's presence and of a template's era.
TERRITORIAL = "respectfully acknowledges|unceded traditional territor|territorial acknowledge"
EQUITY = "employment equity"
OLD_SIGNS = ("position description", "name of employee", r"\bincumbent\b", "minimum entrance qualifications", "typical duties", "supervision (received|exercised)", "summary of responsibility")
NEW_SIGNS = ("impact of decision making", "problem solving and level of supervision", "committed to the principle of employment equity", "respectfully acknowledges", "unceded traditional territor", "initial effective date", "last revised date")
BULLET = r"^[-*•–]\s+"
ENUMERATION = r"^([A-Za-z]|[0-9]{1,2})[.)]\s+"


def lines(text: Column) -> Column:
    """The lines with anything on them, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def heading(line: Column) -> Column:
    """The section that a line is the heading of, null for other lines: no number or letter before it, no colon after."""
    bare = F.upper(F.regexp_replace(F.regexp_replace(F.regexp_replace(line, ENUMERATION, ""), r"[:\s]+$", ""), r"\s+", " "))
    out = None
    for name, pattern in HEADINGS:
        hit = bare.rlike(f"^({pattern})$")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def sections(text: Column) -> Column:
    """(section, lines) of every heading in its order; what stands before the first is section "preamble"."""

    def cut(x: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(x)), lambda i: (i == 0) | heading(F.get(x, i)).isNotNull())
        of = lambda i: F.coalesce(heading(F.get(x, i)), F.lit("preamble"))
        skip = lambda i: heading(F.get(x, i)).isNotNull().cast("int")
        return let(at, lambda p: F.transform(p, lambda i, k: F.struct(of(i).alias("section"), F.slice(x, i + skip(i) + 1, F.coalesce(F.get(p, k + 1), F.size(x)) - i - skip(i)).alias("lines"))))

    return let(lines(text), cut)


def section(parts: Column, name: str) -> Column:
    """The lines of a section; where its heading repeats, one after another."""
    return F.flatten(F.transform(F.filter(parts, lambda p: p["section"] == name), lambda p: p["lines"]))


def logical_lines(some: Column) -> Column:
    """Lines that go on are joined to the bullet before them; bullets lose their mark."""

    def join(x: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | F.get(x, i).rlike(BULLET))
        return let(begins, lambda p: F.transform(p, lambda i, k: F.regexp_replace(F.array_join(F.slice(x, i + 1, F.coalesce(F.get(p, k + 1), F.size(x)) - i), " "), BULLET, "")))

    return F.when(F.size(some) == 0, some).otherwise(let(some, join))


def run_on(some: Column, long: int = 200) -> Column:
    """Long lines with two semicolons or more are split at them."""
    parts = lambda x: F.filter(F.transform(F.split(x, ";"), F.trim), lambda p: p != "")
    return F.flatten(F.transform(some, lambda x: F.when((F.length(x) > long) & (F.regexp_count(x, F.lit(";")) >= 2), parts(x)).otherwise(F.array(x))))


def items(some: Column, most: int) -> Column:
    """Logical lines that aren't the introduction of others, ``most`` at most: a record's lists are bounded by its form."""
    return F.slice(F.filter(logical_lines(some), lambda x: (x != "") & ~F.endswith(x, F.lit(":"))), 1, most)


def duties(some: Column, most: int = 12) -> Column:
    """(verb, statement, share) of each duty: the leading word, the text without its share of time, and that share."""
    share = r"\(([0-9]{1,3})\s*%\)"
    each = F.filter(run_on(logical_lines(some)), lambda x: ~F.endswith(x, F.lit(":")))
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, share, ""), r"\s+", " "))
    verb = lambda x: F.lower(F.regexp_replace(F.regexp_extract(bare(x), "^[^ ]+", 0), "[,.;:]+$", ""))
    made = F.transform(each, lambda x: F.struct(verb(x).alias("verb"), bare(x).alias("statement"), F.nullif(F.regexp_extract(x, share, 1), F.lit("")).cast("int").alias("share")))
    return F.slice(F.filter(made, lambda d: d["statement"] != ""), 1, most)


def qualification_kind(text: Column) -> Column:
    low, out = F.lower(text), None
    for name, pattern in KINDS:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise("ability")


def modifier(text: Column) -> Column:
    """The first word that says how much of a skill or of knowledge is asked for."""
    return F.nullif(F.regexp_extract(F.lower(text), r"\b(excellent|working|basic|intermediate|advanced|expert|strong|good)\b", 1), F.lit(""))


def signs(text: Column, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns a text holds."""
    out = F.lit(0)
    for p in patterns:
        out = out + F.lower(text).rlike(p).cast("int")
    return out


def grade(text: Column) -> Column:
    """The grade of a pay grade line, approved grade or grade remark, in this order; null without one."""
    t = F.coalesce(text, F.lit(""))
    found = [F.regexp_extract(t, p, 1) for p in (r"(?i)grade\s+approved\s*[:#]?\s*((?:PG\s*)?[0-9]{1,2})\b", r"(?im)^[ \t]*(?:pay )?grade[ \t]*[:#][ \t]*((?:PG[ \t]*)?[0-9]{1,2})\b", r"(?i)\b(?:gr\.?|grade)\s*[:#]?\s*([0-9]{1,2})\b")]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found])
