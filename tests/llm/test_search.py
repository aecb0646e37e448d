import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from placewise.llm import search

from .helpers import frame

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans(search.UPPER, search.LOWER)


def terms(text):
    return PATTERN.findall((text or "").translate(SMALL))


def plain(docs, items, k=20):
    found = [(i, Counter(terms(t))) for i, t in docs]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    total = sum(n for *_, n in found)
    held = Counter(t for _, c, _ in found for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, query in asked.items():
        rows = []
        for i, c, n in found:
            m = 100 - 25 + 25 * n * len(found) // total
            score = sum(q * math.floor(1000 * math.log((2 * len(found) + 2) / (2 * held[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in query.items() if t in c)
            if score > 0:
                rows.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


def texts(rng, n, words=300):
    word = lambda: f"w{int(rng.paretovariate(0.6)) % words}"
    return [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(n)]


def found(spark, docs, items, **more):
    return sorted((tuple(r) for r in search.search(frame(spark, docs), frame(spark, items, "item_id long, text string"), **more).collect()), key=str)


@pytest.mark.parametrize("shard", [7, 64, 8192])
def test_against_brute_force(spark, monkeypatch, shard):
    """Small shards pass the k-th score on; ties and copies are frequent."""
    monkeypatch.setattr(search, "SHARD", shard)
    rng = random.Random(shard)
    some = texts(rng, 150)
    docs = [(rng.randrange(10**6), t) for t in some + some[:40]]
    items = [(i, t) for i, t in enumerate(texts(rng, 12))]
    assert found(spark, docs, items, k=5) == plain(docs, items, 5)
    assert found(spark, docs, items) == plain(docs, items)


def test_edges(spark):
    docs = [(1, "Été ÉTÉ a-b"), (None, "été A"), (2, None), (3, ""), (4, "?!"), (5, "a"), (5, "a"), (6, "x" * 3000 + " a"), (7, "naïve space _under_ 3x")]
    items = [(1, "été a A"), (2, None), (3, "..."), (None, "b"), (None, "naïve space"), (4, "not there"), (5, "under 3X")]
    assert found(spark, docs, items) == plain(docs, items)
    assert found(spark, docs, []) == found(spark, [], items) == []


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(search, "PAIRS", 40)
    rng = random.Random(5)
    docs, items = list(enumerate(texts(rng, 60))), list(enumerate(texts(rng, 9)))
    assert found(spark, docs, items, k=3) == plain(docs, items, 3)


def test_long_text_and_other_columns(spark):
    rng = random.Random(6)
    long = " ".join(f"T{rng.randrange(5000)}" for _ in range(400_000))
    docs = [(1, long, "x", 1), (2, "t1 t2 t2", "y", 2)]
    got = search.search(spark.createDataFrame(docs, "doc_id long, text string, terms string, size int"), spark.createDataFrame([(9, "t1 t2 t77", 3)], "item_id long, text string, rank int"))
    assert sorted(tuple(r) for r in got.collect()) == plain([d[:2] for d in docs], [(9, "t1 t2 t77")])


def test_accumulators_stop(spark):
    """A frequent term makes no accumulators once rarer ones have filled the list."""
    import pyarrow as pa

    n = 500
    packed = lambda rows: pa.array([np.array(r, "i4").tobytes() for r in rows], pa.binary())
    held = [[0, 1] if i < 30 else [1] for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([10] * n), packed(held), packed([[1] * len(h) for h in held])], ["doc_id", "size", "terms", "times"])
    shard = search.Shard(batch, np.array([5000, 1]), n, 10 * n)
    scores, places = shard.best(np.array([0, 1]), np.array([1, 1]), 20, 1)
    assert set(places) <= set(range(30)) and len(set(scores)) == 1
