import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

WORDS = "the and of token night river stone light over under bright cold warm seven house garden paper wind song moon".split()


def prose(r: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        w = r.choice(WORDS) + (r.choice(WORDS) if r.random() < 0.5 else "") + str(r.randint(0, 99) if r.random() < 0.2 else "")
        out.append(w + r.choice(["", "", "", "", ".", ",", ".\n"]))
    return " ".join(out)


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empties, white space, ties, near and exact copies, long texts, other scripts."""
    r = random.Random(3)
    base = prose(r, 400)
    words = base.split(" ")
    near = [" ".join(w if i not in cut else "changed" for i, w in enumerate(words)) for cut in ({5}, {5, 90}, {200, 300}, set(range(0, 400, 3)))]
    passage = prose(r, 80)
    texts = [None, "", "   \n\t ", "one", "one two three four", base, base, base.upper(), *near, prose(r, 60) + "\n" + passage + "\n" + prose(r, 60), prose(r, 30) + "\n" + passage, passage]
    texts += ["ä ö ü 漢字 text 😀 " * 30, "a" * 60000, "word " * 20000, prose(r, 12000), "line\n" * 500, "x @ y | # $ %" * 40, "   nbsp em ", prose(r, 9), prose(r, 10)]
    texts += [prose(r, r.randint(1, 200)) for _ in range(40)]
    return [(100 + i, t) for i, t in enumerate(texts)]


def table(spark, rows, **extra):
    """Rows of doc_id and text, with columns whose names operators use themselves."""
    names = ["lang", "source", "n_chars", "score", "kept", "key", "n", "rep", "sig", "spans", "c", "v", "x", "h", "at", "_t", "_w", "_m", "n_words", "broken", "_base", "_spans"]
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), *[StructField(x, LongType() if x == "n_chars" else StringType()) for x in names]])
    return spark.createDataFrame([(i, t, *[None if k % 2 else (7 if x == "n_chars" else "z") for k, x in enumerate(names)]) for i, t in rows], schema)


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    return table(spark, [*odd_texts, odd_texts[5], odd_texts[0]])  # two rows are there twice


@pytest.fixture(scope="session")
def none(spark):
    return table(spark, [])
