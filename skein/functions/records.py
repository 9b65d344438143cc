"""Column builders over records: names, dates, eras, amounts in words, evidence, confidence, messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Number words that amounts are written in.
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
#: The year that each era begins with.
ERAS = ((2023, "current"), (2018, "new"), (2009, "mid"), (0, "old"))


def department(name: Column) -> Column:
    """A department's name for comparison: dashes alike, & as and, lower case, no punctuation, single spaces."""
    t = F.lower(F.translate(name, "‐‑‒–—−", "------"))
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "&", " and "), "[^a-z0-9 ]+", " "), " +", " "))


def date_prefix(name: Column) -> Column:
    """The date that eight leading digits name; null if they name none."""
    digits = F.regexp_extract(name, "^([0-9]{8})", 1)
    return F.try_to_date(F.nullif(digits, F.lit("")), "yyyyMMdd")


def era(date: Column, promoted: Column | None = None) -> Column:
    """The era of a date's year; a promoted record is at least new; unknown without a date."""
    out = F.when(date.isNull(), "unknown")
    if promoted is not None:
        out = out.when(promoted & (F.year(date) < 2018), "new")
    for year, name in ERAS:
        out = out.when(F.year(date) >= year, name)
    return out


def years(text: Column) -> Column:
    """The first amount of years, in digits or in words; null if there is none."""
    t = F.lower(text)
    digits = F.regexp_extract(t, r"([0-9]{1,2})\+? years", 1)
    word = F.regexp_extract(t, f"({'|'.join(NUMBERS)}) years", 1)
    named = F.coalesce(*[F.when(word == w, F.lit(n)) for w, n in NUMBERS.items()])
    at_digits, at_word = F.regexp_instr(t, F.lit(r"[0-9]{1,2}\+? years")), F.regexp_instr(t, F.lit(f"({'|'.join(NUMBERS)}) years"))
    first = (digits != "") & ((at_word == 0) | (at_digits <= at_word))
    return F.when(first, digits.try_cast("int")).otherwise(named)


def evidence(text: Column, term: str, around: int = 20) -> Column:
    """The text around a term's first place, with dots where it is cut; null if it isn't there."""
    at = F.instr(F.lower(text), term)
    start = F.greatest(F.lit(1), at - around)
    size = at + len(term) + around - start
    cut = F.substring(text, start, size)
    return F.when(at > 0, F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(start + size - 1 < F.length(text), "…").otherwise("")))


def bounded_list(items: Column, most: int) -> Column:
    """The first items joined by commas, with dots if there are more."""
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(F.size(items) > most, ", …").otherwise(""))


def retruncated(text: Column, most: int) -> Column:
    """A text without its last lines as far as it is too long; whole lines only."""
    step = lambda a, x: F.when(a["stop"] | (a["n"] + F.length(x) + 1 > most + 1), F.struct(a["s"].alias("s"), a["n"].alias("n"), F.lit(True).alias("stop"))).otherwise(
        F.struct(F.array_append(a["s"], x).alias("s"), (a["n"] + F.length(x) + 1).alias("n"), F.lit(False).alias("stop"))
    )
    start = F.struct(F.array().cast("array<string>").alias("s"), F.lit(0).alias("n"), F.lit(False).alias("stop"))
    return F.aggregate(F.split(text, "\n"), start, step, lambda a: F.array_join(a["s"], "\n"))


def section_confidence(present: Column, structured: Column) -> Column:
    return F.when(present & structured, 0.9).when(present, 0.4).otherwise(0.0)


def parse_confidence(parts: list[Column]) -> Column:
    """The mean of the sections' confidences, to four digits."""
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.round(total / len(parts), 4)


def message(template: str, **values: Column) -> Column:
    """A template's text with its {names} replaced."""
    out = F.lit(template)
    for name, v in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), v.cast("string"))
    return out


def level(points: Column, ladder: tuple[tuple[int, str], ...], default: str) -> Column:
    """The first rung that the points reach."""
    out = None
    for least, name in ladder:
        out = F.when(points >= least, name) if out is None else out.when(points >= least, name)
    return out.otherwise(default)


def cells(line: Column) -> Column:
    """The cells of a table's line, trimmed."""
    return F.transform(F.split(line, r"\|"), lambda c: F.trim(c))


def paired_cells(line: Column) -> Column:
    """Label and value cells side by side as "label: value" entries, the last one alone if their number is odd."""
    return let(cells(line), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 1, F.lit(2)), lambda i: F.concat_ws(": ", F.get(c, i), F.get(c, i + 1))))
