"""What depends on the order of a cluster's statements, done for one cluster at a time in Python.

A cluster is small by rule (oversize ones are flagged before), so a group is bounded.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame

from skein.config import MergeConfig
from skein.session import ship

_TOKEN = re.compile("[a-z0-9]+")


def token_jaccard(a: frozenset[str], b: frozenset[str]) -> float:
    """Similarity of two token sets; two empty ones are alike."""
    return len(a & b) / len(a | b) if a or b else 1.0


def greedy_groups(statements: list[tuple[str, int]], least: float) -> list[list[tuple[str, int]]]:
    """Statements in order, each into the first group whose seed is that similar, else a group of its own."""
    groups: list[tuple[frozenset[str], list[tuple[str, int]]]] = []
    for text, member in sorted(statements):
        tokens = frozenset(_TOKEN.findall(text.lower()))
        for seed, held in groups:
            if token_jaccard(seed, tokens) >= least:
                held.append((text, member))
                break
        else:
            groups.append((tokens, [(text, member)]))
    return [held for _, held in groups]


def grouped_statements(df: DataFrame, cluster: str, member: str, statement: str, cfg: MergeConfig = MergeConfig()) -> DataFrame:
    """A row for each group: its representative (longest, then last in the alphabet), members and whether the cap keeps it."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = greedy_groups(list(zip(pdf[statement], pdf[member], strict=True)), cfg.jaccard)
        rows = [(max(g, key=lambda s: (len(s[0]), s[0]))[0], len({m for _, m in g})) for g in groups]
        rows.sort(key=lambda r: (-r[1], r[0]))
        return pd.DataFrame([(pdf[cluster].iloc[0], r, n, i, i < cfg.max_statements) for i, (r, n) in enumerate(rows)], columns=[cluster, "representative", "members", "place", "kept"])

    ship(df.sparkSession)
    return df.select(cluster, member, statement).groupBy(cluster).applyInPandas(one, f"{cluster} long, representative string, members int, place int, kept boolean")


def word_diffs(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place, kind (equal, delete, insert), words: the diff of ``before`` and ``after`` as spans of words."""
    types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                a, b = (r.before or "").split(), (r.after or "").split()
                place = 0
                for op, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
                    for kind, words in (("equal", a[i:j]),) if op == "equal" else (("delete", a[i:j]), ("insert", b[k:m])):
                        if words:
                            rows.append((*[getattr(r, x) for x in keys], place, kind, " ".join(words)))
                            place += 1
            yield pd.DataFrame(rows, columns=[*keys, "place", "kind", "words"])

    ship(df.sparkSession)
    return df.mapInPandas(run, f"{types}, place int, kind string, words string")
