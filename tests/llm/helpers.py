"""Small inputs and plain reference versions for the operator tests."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, component_id string, n string, anchor string, lines string"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def clashing(spark, rows):
    """Documents with further columns named like the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", "x", "y", "z", "w") for i, t in rows], DOCS)


def groups(nodes, links):
    """{node: smallest node reachable}"""
    low = {n: n for n in nodes}

    def top(n):
        while low[n] != n:
            n = low[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        low[b] = a
    return {n: top(n) for n in nodes}


def prose(seed, n, words=400):
    rng = random.Random(seed)
    return " ".join(f"w{int(rng.paretovariate(0.8)) % words}" for _ in range(n))
