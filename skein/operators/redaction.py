"""Cutting prescribed passages out of texts: every verbatim occurrence, overlapping ones as one cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of the run by which a passage is looked up, from its second word on.
ANCHOR = 6


def _words(c) -> Column:
    return F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")


def holding(docs: DataFrame, passages: DataFrame, block: int = 500) -> DataFrame:
    """doc_id, item_id, passage of every text that holds a passage verbatim.

    Passages of eight words or more meet texts by a hash of a run of their words, so no text meets every
    passage. Shorter ones have no run that must be whole in a text: they are a stated set that goes to the
    texts in blocks of bounded size.
    """
    items = passages.filter("length(text) > 0").select("item_id", F.col("text").alias("passage")).withColumn("w", _words("passage"))
    long = items.filter(F.size("w") >= ANCHOR + 2).select("item_id", "passage", F.xxhash64(F.array_join(F.slice("w", 2, ANCHOR), " ")).alias("k"))
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - ANCHOR + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, ANCHOR), " ")))
    keys = docs.select("doc_id", _words("text").alias("w")).select("doc_id", F.explode(F.array_distinct(runs(F.col("w")))).alias("k"))
    found = keys.join(long, "k").select("doc_id", "item_id", "passage").distinct()
    out = found.join(docs.select("doc_id", "text"), "doc_id").filter(F.contains("text", F.col("passage"))).select("doc_id", "item_id", "passage")
    short = items.filter(F.size("w") < ANCHOR + 2).select("item_id", "passage")
    n = short.count()
    for k in range(-(-n // block)):
        part = short.filter(F.pmod(F.xxhash64("item_id", "passage"), F.lit(-(-n // block))) == k)
        own = F.array(*[F.struct(F.lit(r.item_id).alias("item_id"), F.lit(r.passage).alias("passage")) for r in part.toLocalIterator()])
        hit = F.filter(own, lambda p: F.contains("text", p["passage"]))
        out = out.unionByName(docs.filter("text is not null").select("doc_id", F.explode(hit).alias("p")).select("doc_id", "p.item_id", "p.passage"))
    return out


def spans(text: Column, passage: Column) -> Column:
    """(s, e) of every occurrence of a passage, from the lengths of what lies between."""
    between = F.split(text, F.concat(F.lit(r"\Q"), passage, F.lit(r"\E")), F.lit(-1))
    step = lambda a, x: F.struct((a["at"] + F.length(x) + F.length(passage)).alias("at"), F.array_append(a["out"], F.struct((a["at"] + F.length(x)).alias("s"), (a["at"] + F.length(x) + F.length(passage)).alias("e"))).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))
    return F.aggregate(F.slice(between, F.lit(1), F.size(between) - 1), start, step, lambda a: a["out"])


def redacted(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """doc_id, text without the passages (a space for each cut), n_cuts, for every row of ``docs``."""
    own = holding(docs, passages).join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "text", F.explode(spans(F.col("text"), F.col("passage"))).alias("x"))
    # as many spans as a text has occurrences of the set
    by = own.groupBy("doc_id").agg(F.first("text").alias("whole"), F.array_sort(F.collect_set("x")).alias("spans"))
    none = F.array().cast("array<string>")
    piece = lambda a, x: F.when(x["s"] < a["to"], a["out"]).otherwise(F.array_append(a["out"], F.substring("whole", a["to"] + 1, x["s"] - a["to"])))
    start = F.struct(F.lit(0).alias("to"), none.alias("out"))
    cut = F.aggregate("spans", start, lambda a, x: F.struct(F.greatest(a["to"], x["e"]).alias("to"), piece(a, x).alias("out")))
    done = by.withColumn("c", cut).select("doc_id", F.concat(F.array_join("c.out", " "), F.lit(" "), F.substring("whole", F.col("c.to") + 1, F.length("whole"))).alias("clean"), F.size("c.out").alias("cuts"))
    return docs.select("doc_id", "text").join(done, "doc_id", "left").select("doc_id", F.coalesce("clean", "text").alias("text"), F.coalesce("cuts", F.lit(0)).cast("long").alias("n_cuts"))
