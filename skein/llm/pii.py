"""Personal data: recall-oriented generators, boosted trees over their candidates, calibrated thresholds.

Base kinds (email, ip, card, phone) are fixed patterns with a check; their spans always stay. Further
generators propose overlapping candidates of other kinds. Boosted trees judge each by its format and its
context; a threshold for each kind, calibrated on examples that the trees have not seen, selects what
is added. A candidate that overlaps a base span, or a better candidate, is left out.

The trees are fitted on examples made from templates with a fixed seed (there are no labelled spans in
the data) and compiled into one expression, so that the texts see built-in functions only: no Python runs
on the executors. The patterns take time linear in the text, long runs included.

Null texts are empty and have no spans. Positions are code points, ends exclusive. Repeated rows are
judged each; extra columns are not read, or pass through ``redact`` unchanged, whatever their names.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gbt
from .common import table
from .rules import let

#: Kinds with fixed patterns, in the order that breaks ties, then the kinds that the trees decide on.
BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "masked_email", "national_phone", "national_id", "iban", "hardware", "account")
KINDS = BASE + ADDED

_LOCAL = "[A-Za-z0-9._%+-]"
_TOKEN = "[A-Za-z0-9_+/=-]"
#: One match of each is one candidate. Look-behinds and possessive repeats keep long runs linear.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": rf"(?<!{_TOKEN})(?=[0-9_+/=-]*+[A-Za-z]){_TOKEN}{{16,}}+",
    "masked_email": rf"(?<!{_LOCAL}){_LOCAL}++ ?(?:\(at\)|\[at\]| at )\s?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\bdot\b|\.) ?[A-Za-z0-9-]++)++",
    "national_phone": r"(?<![0-9+(.-])\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])(?![.-][0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "hardware": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}[:-]){4,7}+[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "account": r"(?<![0-9A-Za-z.+-])[0-9]{9,19}+(?![0-9])",
}
#: Words near a candidate that speak for a kind, or against all. Matched in the 32 characters before it.
CONTEXT = {
    "secret": "token|secret|passw|pwd|api.?key|key|bearer|credential|auth",
    "mail": "mail|contact|write|reach|@|address",
    "phone": "phone|tel|call|mobile|cell|fax|number|whatsapp",
    "identity": "ssn|social|passport|iban|account|acct|card|tax|licen|born|patient|member|id\\b",
    "network": "\\bip\\b|host|server|mac\\b|address|device",
    "against": "version|release|isbn|issn|doi|order|page|chapter|line|build|commit|sha|hash|price|total|usd|eur|sku|part no|model|revision|http|www",
}
_SPAN = "array<struct<s:int,k:int,e:int,v:string>>"


@dataclass(frozen=True)
class PiiConfig:
    examples: int = 240  # made for each template family
    seed: int = 7
    precision: float = 0.97  # that a threshold must reach on the held-out examples
    trees: int = 24
    depth: int = 3


def running(values: Column, both) -> Column:
    """Each element combined by ``both`` with all before it, by doubling: as many passes as the size has bits."""
    passes = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.floor(F.log2(F.size(values))).cast("int"))).otherwise(F.array().cast("array<int>"))
    far = lambda k: F.call_function("shiftleft", F.lit(1), k)
    return F.aggregate(passes, values, lambda a, k: F.transform(a, lambda x, i: F.when(i >= far(k), both(x, F.get(a, i - far(k)))).otherwise(x)))


def found(text: Column, kind: str, guard: Column) -> Column:
    """All matches of a kind with their places: lengths of what lies between matches, added up."""
    k = KINDS.index(kind)
    none = F.array().cast(_SPAN)

    def placed(m: Column) -> Column:
        size = F.transform(m["found"], lambda v, i: F.length(F.get(m["between"], i)) + F.length(v))
        return let(
            running(size, lambda x, y: x + y),
            lambda end: F.transform(m["found"], lambda v, i: F.struct((F.get(end, i) - F.length(v)).alias("s"), F.lit(k).alias("k"), F.get(end, i).alias("e"), v.alias("v"))).cast(_SPAN),
        )

    pattern = PATTERNS[kind]
    both = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(guard, let(both, lambda m: F.when(F.size(m["found"]) > 0, placed(m)).otherwise(none))).otherwise(none)


#: Code points of a chunk; places are looked up in their chunk, not counted from the start of the text.
CHUNK = 256


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def between(parts: Column, a: Column, b: Column) -> Column:
    """The code points of a text from a to b, out of its chunks."""
    of = lambda x: F.floor(x / CHUNK).cast("int")
    one = F.coalesce(F.get(parts, of(a)), F.lit(""))
    ends = lambda: F.concat(
        F.substring(one, a % CHUNK + 1, F.lit(CHUNK)),
        F.array_join(F.slice(parts, of(a) + 2, F.greatest(of(b) - of(a) - 1, F.lit(0))), ""),
        F.substring(F.coalesce(F.get(parts, of(b)), F.lit("")), F.lit(1), b % CHUNK),
    )
    return F.when(b <= a, "").when(of(a) == of(b), F.substring(one, a % CHUNK + 1, b - a)).otherwise(ends())


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]+", "")


def luhn(v: Column) -> Column:
    """Whether the digits of ``v`` pass the check."""
    each = F.filter(F.split(F.reverse(digits(v)), ""), lambda c: c != "")
    value = F.transform(each, lambda c, i: c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(value, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def octets(v: Column) -> Column:
    """Whether every part is at most 255, whatever zeros lead it."""
    part = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(v, r"\."), lambda p: (F.length(part(p)) < 4) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))


def base_spans(text: Column) -> Column:
    """The spans of the fixed kinds that pass their checks, by start and then kind."""
    has_digit = text.rlike("[0-9]")
    n = lambda x: F.length(digits(x["v"]))
    parts = (
        found(text, "email", text.contains("@")),
        F.filter(found(text, "ip", has_digit & text.contains(".")), lambda x: octets(x["v"])),
        F.filter(found(text, "card", has_digit), lambda x: luhn(x["v"])),
        F.filter(found(text, "phone", has_digit & text.contains("+")), lambda x: n(x).between(10, 15)),
    )
    return F.array_sort(F.concat(*parts))


def candidates(text: Column) -> Column:
    """Overlapping proposals of the other kinds."""
    has_digit = text.rlike("[0-9]")
    masked = text.contains("(at)") | text.contains("[at]") | text.rlike(r"\bat\b[^\n]{1,60}\bdot\b")
    return F.concat(*[found(text, k, masked if k == "masked_email" else has_digit) for k in ADDED])


FEATURES = (
    "kind", "length", "n_digits", "n_upper", "n_lower", "n_other", "distinct", "luhn", "hex", "changes", "groups",
    *[f"near_{c}" for c in CONTEXT], "quoted", "glued_left", "glued_right", "money", "leading_zero", "same_digit",
)


def described(x: Column, parts: Column) -> Column:
    """The FEATURES of a candidate, as an array of doubles; ``parts`` are the chunks of the text."""
    v = x["v"]
    of = lambda p: F.length(v) - F.length(F.regexp_replace(v, p, ""))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    before = F.lower(between(parts, F.greatest(x["s"] - 32, F.lit(0)), x["s"]))
    last = between(parts, F.greatest(x["s"] - 1, F.lit(0)), x["s"])
    after = between(parts, x["e"], x["e"] + 1)
    return F.array(
        x["k"].cast("double"),
        F.length(v).cast("double"),
        of("[0-9]+").cast("double"),
        of("[A-Z]+").cast("double"),
        of("[a-z]+").cast("double"),
        of("[^0-9A-Za-z]+").cast("double"),
        F.size(F.array_distinct(F.split(v, ""))) / F.length(v),
        flag(luhn(v)),
        flag(v.rlike("^[0-9a-f]+$") | v.rlike("^[0-9A-F]+$")),
        F.regexp_count(v, F.lit("[A-Za-z][0-9]|[0-9][A-Za-z]")).cast("double"),
        F.regexp_count(v, F.lit("[^0-9A-Za-z]+")).cast("double"),
        *[flag(before.rlike(p)) for p in CONTEXT.values()],
        flag(last.isin('"', "'", "`", "=")),
        flag(last.rlike("[A-Za-z0-9_./-]")),
        flag(after.rlike("[A-Za-z0-9_/%-]")),
        flag(last.isin("$", "€", "£", "#")),
        flag(digits(v).startswith("0")),
        flag(v.rlike(r"^([0-9])\1+$")),
    )


# ---- examples -------------------------------------------------------------------------------------


def examples(cfg: PiiConfig) -> list[dict]:
    """Texts with one marked string each; ``y`` tells whether it is personal."""
    r = random.Random(cfg.seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    pick = lambda s, n: "".join(r.choice(s) for _ in range(n))
    hexa = lambda n: pick("0123456789abcdef", n)
    mixed = lambda n: pick("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", n)
    word = lambda: pick("bcdfglmnprst", 1) + pick("aeiou", 1) + pick("bcdfglmnprst", 1) + pick("aeiou", 1) + pick("nrst", r.randint(0, 1))
    some = lambda n: " ".join(word() for _ in range(n))
    quote = lambda v: r.choice([f'"{v}"', f"'{v}'", v])
    secret_word = ["token = ", "api_key: ", "secret=", "password is ", "Authorization: Bearer ", "key = ", "passwd: ", "auth token "]
    phone_word = ["call ", "phone: ", "tel. ", "mobile ", "fax ", "reach me on ", "ring ", ""]
    id_word = ["SSN ", "social security number ", "ssn: ", "tax id ", "patient id ", ""]
    bank_word = ["IBAN ", "account ", "pay to ", "iban: ", ""]
    card_word = ["card ", "account number ", "acct ", "my number is ", "passport ", "", "", ""]
    bad_word = ["version ", "ISBN ", "order ", "commit ", "sha256 ", "build ", "price ", "SKU ", "part no ", "http://x.example/", "page ", "total "]
    sep = lambda: r.choice(["-", ".", " "])
    good = {
        "secret": lambda: (r.choice(secret_word), r.choice([lambda: hexa(r.choice([32, 38, 40, 64])), lambda: mixed(r.randint(20, 48)), lambda: f"sk-{mixed(32)}", lambda: f"AKIA{pick('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 16)}"])()),
        "masked_email": lambda: (r.choice(["mail ", "write to ", "contact ", ""]), f"{word()}.{word()}{r.choice([' (at) ', '(at)', ' [at] ', '[at]', ' at '])}{word()}{r.choice([' (dot) ', '[dot]', ' dot ', ' [dot] '])}{r.choice(['com', 'org', 'net', 'de'])}"),
        "national_phone": lambda: (r.choice(phone_word), (lambda s: r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}{s}{d(3)}{s}{d(4)}", f"0{d(3)}{s}{d(3)}{s}{d(4)}"]))(sep())),
        "national_id": lambda: (r.choice(id_word), f"{d(3)}-{d(2)}-{d(4)}"),
        "iban": lambda: (r.choice(bank_word), (lambda c, b: r.choice([f"{c}{d(2)}{b}", f"{c}{d(2)} " + " ".join(b[i : i + 4] for i in range(0, len(b), 4))]))(r.choice(["DE", "GB", "FR", "ES", "NL"]), d(r.choice([16, 18, 20])))),
        "hardware": lambda: (r.choice(["mac ", "device ", "ip ", "host ", ""]), r.choice([":".join(hexa(2) for _ in range(6)), "-".join(hexa(2) for _ in range(6)), ":".join(hexa(4) for _ in range(8))])),
        "account": lambda: (r.choice(card_word), d(r.choice([13, 15, 16, 16, 16, 16, 19]))),
    }
    bad = [
        lambda: (r.choice(["commit ", "sha ", "hash ", "checksum ", "build "]), hexa(r.choice([40, 64, 32]))),
        lambda: ("", f"{some(1)}-{some(1)}-{some(1)}-{word()}{r.randint(1, 99)}"),
        lambda: ("http://www.example.org/", f"{word()}-{word()}-{word()}-{d(2)}"),
        lambda: (r.choice(["ISBN ", "isbn: "]), r.choice([f"978{d(10)}", f"978-{d(1)}-{d(3)}-{d(5)}-{d(1)}", d(10)])),
        lambda: (r.choice(["order ", "SKU ", "part no ", "model ", "#"]), d(r.randint(9, 14))),
        lambda: (r.choice(["on ", "date ", "since ", ""]), f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}"),
        lambda: (r.choice(["from ", "years ", ""]), f"{r.randint(1900, 2030)} {r.randint(1900, 2030)} {r.randint(1900, 2030)}"),
        lambda: (r.choice(["version ", "release "]), f"{d(2)}.{d(3)}.{d(3)}"),
        lambda: (r.choice(["$", "total $", "price €"]), f"{d(3)} {d(3)} {d(3)}"),
        lambda: (r.choice(["at ", "time ", ""]), f"{d(2)}:{d(2)}:{d(2)}:{d(2)}:{d(2)}"),
        lambda: ("", pick("=-_", 1) * r.randint(16, 60)),
        lambda: ("", r.choice("0123456789") * r.randint(9, 19)),
        lambda: (r.choice(["doi ", "page ", "line "]), f"{d(3)}-{d(3)}-{d(4)}"),
        lambda: ("", f"{word()}_{word()}_{word()}_{word()}{d(1)}"),
        lambda: ("meet ", f"{word()} at {word()} dot {word()}") if r.random() < 0.3 else ("seen ", f"{word()} at {word()}.{word()}"),
        lambda: (r.choice(bad_word), mixed(r.randint(16, 30))),
    ]
    out = []
    for y, makers in ((1, list(good.values())), (0, bad)):
        for make in makers:
            for _ in range(cfg.examples if y else cfg.examples * len(good) // len(bad)):
                lead, v = make()
                head = f"{some(r.randint(0, 6))} {lead}".lstrip()
                q = quote(v) if make is good["secret"] else v
                text = f"{head}{q}{r.choice(['', '.', ',', ' '])} {some(r.randint(0, 5))}".rstrip()
                at = text.index(v, len(head))
                out.append({"i": len(out), "t": text, "s": at, "e": at + len(v), "y": y})
    return out


_MODELS: dict[PiiConfig, tuple[gbt.Gbt, dict[int, float]]] = {}


def trained(spark: SparkSession, cfg: PiiConfig = PiiConfig()) -> tuple[gbt.Gbt, dict[int, float]]:
    """The trees and each kind's threshold on their margin. Every third example only calibrates."""
    if cfg in _MODELS:
        return _MODELS[cfg]
    made = F.from_json(F.lit(json.dumps(examples(cfg))), "array<struct<i:int,t:string,s:int,e:int,y:int>>")
    rows = spark.range(1).select(F.explode(made).alias("r")).select("r.*")
    each = rows.select("i", "s", "e", "y", "t", F.explode(candidates(F.col("t"))).alias("c"))
    got = each.select("i", "y", F.col("c.k").alias("k"), ((F.col("c.s") < F.col("e")) & (F.col("c.e") > F.col("s"))).alias("hit"), described(F.col("c"), chunks(F.col("t"))).alias("x")).collect()
    x, y = np.array([g.x for g in got]), np.array([float(g.y and g.hit) for g in got])
    fold = np.array([g.i % 3 == 0 for g in got])
    model = gbt.fit(x[~fold], y[~fold], gbt.GbtConfig(trees=cfg.trees, depth=cfg.depth))
    margin = model.margin(x)
    cut = {}
    for name in ADDED:
        k = KINDS.index(name)
        own = fold & (x[:, 0] == k)
        order = np.argsort(-margin[own], kind="stable")
        m, right = margin[own][order], np.cumsum(y[own][order])
        ok = np.flatnonzero(right / np.arange(1, len(m) + 1) >= cfg.precision) if len(m) else []
        cut[k] = float(m[ok[-1]]) if len(ok) else float("inf")
    _MODELS[cfg] = model, cut
    return model, cut


def free(found_: Column, base: Column) -> Column:
    """The candidates that cross no base span: one order of all by start, the largest base end before and the next base start."""
    place = lambda t: lambda x: F.struct(x["s"].alias("s"), F.lit(t).alias("t"), x["e"].alias("e"), x.alias("c"))

    def clear(every: Column) -> Column:
        reach = running(F.transform(every, lambda x: F.when(x["t"] == 0, x["e"]).otherwise(0)), F.greatest)
        ahead = F.reverse(running(F.transform(F.reverse(every), lambda x: F.when(x["t"] == 0, x["s"]).otherwise(F.lit(2**31 - 1))), F.least))
        keep = lambda r, n: F.filter(every, lambda x, i: (x["t"] == 1) & (F.get(r, i) <= x["s"]) & (F.get(n, i) >= x["e"]))
        return let(reach, lambda r: let(ahead, lambda n: F.transform(keep(r, n), lambda x: x["c"])))

    both = F.array_sort(F.concat(F.transform(base, place(0)), F.transform(found_, place(1))))
    return F.when((F.size(base) == 0) | (F.size(found_) == 0), found_).otherwise(let(both, clear))


def added_spans(text: Column, base: Column, model: gbt.Gbt, cut: dict[int, float]) -> Column:
    """Candidates over their kind's threshold, without overlaps: best margin first, base spans before all.

    Candidates that overlap, one after another, are a group of their own, so that each is compared with
    those of its group only.
    """
    none = F.array().cast(_SPAN)
    least = F.create_map(*[v for k, t in cut.items() for v in (F.lit(k), F.lit(t))])
    over = lambda j: j["z"] >= F.element_at(least, j["c"]["k"])
    crosses = lambda a, b: (a["s"] < b["e"]) & (b["s"] < a["e"])

    def judged(c: Column, parts: Column) -> Column:
        return let(described(c, parts), lambda f: F.struct(model.compiled(lambda j: F.get(f, F.lit(j))).alias("z"), c.alias("c")))

    def best(group: Column) -> Column:
        first = F.array_sort(F.transform(group, lambda j: F.struct((-j["z"]).alias("z"), j["c"].alias("c"))))
        take = lambda a, j: F.when(F.exists(a, lambda b: crosses(j["c"], b)), a).otherwise(F.array_append(a, j["c"]))
        return F.when(F.size(group) == 1, F.transform(group, lambda j: j["c"])).otherwise(F.aggregate(first, none, take))

    def chosen(good: Column) -> Column:
        def split(at: Column) -> Column:
            size = lambda x, i: F.coalesce(F.get(at, i + 1), F.size(good)) - x
            return F.flatten(F.transform(at, lambda x, i: best(F.slice(good, x + 1, size(x, i)))))

        reach = running(F.transform(good, lambda j: j["c"]["e"]), F.greatest)
        begins = lambda r: F.filter(F.sequence(F.lit(0), F.size(good) - 1), lambda i: (i == 0) | (F.get(good, i)["c"]["s"] >= F.get(r, i - 1)))
        return F.when(F.size(good) == 0, none).otherwise(let(reach, lambda r: let(begins(r), split)))

    def of(some: Column) -> Column:
        all_ = let(chunks(text), lambda parts: F.filter(F.transform(some, lambda c: judged(c, parts)), over))
        by_place = F.array_sort(F.transform(all_, lambda j: F.struct(j["c"]["s"].alias("s"), j["z"].alias("z"), j["c"].alias("c"))))
        return let(by_place, chosen)

    return let(free(candidates(text), base), lambda some: F.when(F.size(some) == 0, none).otherwise(of(some)))


def detect(docs: DataFrame, cfg: PiiConfig = PiiConfig(), text: str = "text") -> DataFrame:
    """``docs`` with ``_base`` and ``_spans``: arrays of (s, k, e, v), k an index of KINDS, by start and kind."""
    model, cut = trained(docs.sparkSession, cfg)
    t = F.col("_skein_t")
    out = docs.withColumn("_skein_t", F.coalesce(docs[text], F.lit(""))).withColumn("_base", base_spans(t))
    return out.withColumn("_spans", F.array_sort(F.concat("_base", added_spans(t, F.col("_base"), model, cut)))).drop("_skein_t")


def redact(docs: DataFrame, cfg: PiiConfig = PiiConfig()) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets, and ``n_chars`` (if there) to match."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def cutout(v: Column) -> Column:
        # what earlier spans cover, so that overlapping spans make one gap
        reach = running(F.transform(v["p"], lambda s: s["e"]), F.greatest)
        before = lambda r, i: F.when(i == 0, 0).otherwise(F.get(r, i - 1))
        piece = lambda r, parts: lambda s, i: let(before(r, i), lambda at: F.when(s["s"] < at, "").otherwise(F.concat(between(parts, at, s["s"]), F.get(names, s["k"]))))
        rest = lambda r, parts: between(parts, F.get(r, F.size(r) - 1), F.length(v["t"]))
        return let(reach, lambda r: let(chunks(v["t"]), lambda parts: F.concat(F.array_join(F.transform(v["p"], piece(r, parts)), ""), rest(r, parts))))

    seen = detect(docs.select("text", F.struct(*[docs[c] for c in docs.columns]).alias("row")), cfg)
    clean = F.when(F.size("_spans") > 0, let(F.struct(F.col("_spans").alias("p"), F.col("text").alias("t")), cutout)).otherwise(F.col("text"))
    out = seen.withColumn("clean", clean)
    found = F.size("_spans") > 0

    def column(c: str) -> Column:
        own = F.col("row").getField(c)
        if c == "text":
            return F.col("clean").alias(c)
        if c == "n_chars":
            return F.when(found, F.length("clean").cast(docs.schema[c].dataType)).otherwise(own).alias(c)
        return own.alias(c)

    return out.select(*[column(c) for c in docs.columns])


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["s"].cast("string"), s["e"].cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("_base", lambda s: s["k"] == BASE.index(k))).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(F.col("_base")), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"))
