"""Column builders over text. Patterns keep to what Java and RE2 share, so that SQL can state the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Typographic characters and what they are folded to.
TYPOGRAPHIC = {
    "‘": "'", "’": "'", "‚": "'", "‛": "'", "′": "'", "“": '"', "”": '"', "„": '"', "″": '"',
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-",
}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}

EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+"
PHONE = r"\+?[0-9](?:[().\s-]*[0-9]){9,}"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(text: Column, lower: bool = True) -> Column:
    """Format characters gone, typographic ones plain, white-space runs one space (a blank line: one line break)."""
    t = F.regexp_replace(text, r"\p{Cf}", "")
    t = F.translate(t, "".join(TYPOGRAPHIC), "".join(TYPOGRAPHIC.values()))
    for a, b in LIGATURES.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(t, r"[ \t\r\f\x0B]*\n[ \t\r\f\x0B]*\n\s*", " ")
    t = F.regexp_replace(t, r"\s+", " ")
    t = F.trim(F.replace(t, F.lit(" "), F.lit("\n")))
    return F.lower(t) if lower else t


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def shingles(tok: Column, k: int) -> Column:
    """Distinct runs of ``k`` tokens, joined by spaces; none if there are fewer tokens."""
    runs = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - k + 1), lambda i: F.array_join(F.slice(t, i, k), " "))
    none = F.array().cast("array<string>")
    return let(tok, lambda t: F.when(F.size(t) >= k, F.array_distinct(runs(t))).otherwise(none))


def hashed_shingles(tok: Column, k: int) -> Column:
    """Distinct 64-bit hashes of the runs of ``k`` tokens: each token is hashed once and no run is made a string."""
    run = lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - (k - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]))
    return let(F.transform(tok, lambda t: F.xxhash64(t)), lambda h: F.array_distinct(run(h)))


def normalized_title(title: Column, stop: tuple[str, ...]) -> Column:
    return F.array_join(F.filter(tokens(title), lambda t: ~t.isin(*stop)), " ")


def padded_title(title: Column) -> Column:
    """Lower case, everything else one space, a space at either end: keyword search by containment."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " ")), F.lit(" "))


def like_escaped(text: str) -> str:
    """User text as a LIKE pattern that contains it."""
    return "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def contains_ci(column: Column, text: str) -> Column:
    return F.contains(F.lower(column), F.lit(text.lower()))


def first_keyword(padded: Column, ladder: dict[str, list[str]], markers: tuple[str, ...] = (), default: str = "unmapped") -> Column:
    """The first rung with a keyword in the title, which ends at the earliest marker."""
    ends = [F.when(F.instr(padded, m) > 0, F.instr(padded, m)) for m in markers]
    end = F.least(*ends, F.lit(1 << 20)) if len(ends) > 1 else F.coalesce(ends[0], F.lit(1 << 20)) if ends else F.lit(1 << 20)
    head = F.concat(F.substring(padded, F.lit(1), end - 1), F.lit(" "))
    out = None
    for rung, words in ladder.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(head, F.lit(w))
        out = F.when(hit, rung) if out is None else out.when(hit, rung)
    return out.otherwise(default)


def scrubbed(text: Column) -> Column:
    """E-mail addresses and numbers of ten or more digits masked."""
    return F.regexp_replace(F.regexp_replace(text, EMAIL, "[contact redacted]"), PHONE, "[contact redacted]")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words, each word with two spaces before and one after."""
    word = lambda w: let(F.concat(F.lit("  "), w, F.lit(" ")), lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(F.transform(tokens(text), word)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; 0 without any."""
    return jaccard(trigrams(a), trigrams(b))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Exact similarity of two arrays as sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def grounded(tok: Column, vocabulary: Column, share: float) -> Column:
    """Whether enough of the tokens are in the vocabulary; no tokens are grounded."""
    n = F.size(tok)
    return F.when(n == 0, True).otherwise(F.size(F.filter(tok, lambda t: F.array_contains(vocabulary, t))) >= share * n)


def serialized(parts: Column, most: int) -> Column:
    """Parts joined by line breaks, whole parts only, up to ``most`` characters."""
    step = lambda a, p: F.when(a["stop"] | (F.length(a["s"]) + F.length(p) + F.when(a["s"] == "", 0).otherwise(1) > most), F.struct(a["s"].alias("s"), F.lit(True).alias("stop"))).otherwise(
        F.struct(F.when(a["s"] == "", p).otherwise(F.concat_ws("\n", a["s"], p)).alias("s"), F.lit(False).alias("stop"))
    )
    return F.aggregate(parts, F.struct(F.lit("").alias("s"), F.lit(False).alias("stop")), step, lambda a: a["s"])


def s_curve(n_bands: int, rows: int) -> float:
    """The similarity at which a pair is about as likely found as not."""
    return (1.0 / n_bands) ** (1.0 / rows)
