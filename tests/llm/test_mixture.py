import heapq
import random

from placewise.llm import mixture

from .helpers import prose

SCHEMA = "doc_id long, text string, source string, size string, taken string"


def plain_targets(sizes):
    """Shares by weight; capped sources leave, one after the other, until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, free, out = sum(sizes.values()), set(names), {}
    while free:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 3 * sizes[s]]
        if not over:
            return out | share
        out |= {s: 3 * sizes[s] for s in over}
        free -= set(over)
    return out


def check(spark, rows, block):
    docs = spark.createDataFrame([(i, t, s, "", "") for i, t, s in rows], SCHEMA)
    got = mixture.mix(docs, block=block).collect()
    assert len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    by_id = {i: s for i, _, s in rows}
    for r in got:
        s = by_id[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r.size and r.taken == sum(p.words * p.times for p in r.parts) and r.size == sum(p.words for p in r.parts)
    want = plain_targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) <= 1e-6 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= 1.5 * block + 1
    assert all(r.source_size == sizes[by_id[r.doc_id]] for r in got)
    again = mixture.mix(docs.repartition(7), block=block).collect()
    assert sorted((str(r.doc_id), r.text_hash or 0, r.taken) for r in got) == sorted((str(r.doc_id), r.text_hash or 0, r.taken) for r in again)
    return docs


def test_hot_and_small_sources(spark):
    rng = random.Random(1)
    rows = [(i, prose(i, rng.randint(1, 300)), "hot") for i in range(150)]
    rows += [(1000 + i, prose(i, rng.randint(0, 60)), rng.choice(["a", "b", "é", None, "z"])) for i in range(80)]
    rows += [(2000, None, "a"), (2001, "", "none"), (2002, " \n", "none"), (2003, prose(1, 5000), "b"), (2004, "one", "tiny")]
    docs = check(spark, rows, 16)
    out = mixture.mixed(docs, block=16)
    assert out.columns == docs.columns
    taken = {r.doc_id: r.taken for r in mixture.mix(docs, block=16).collect()}
    words, texts = {}, {i: (t or "").split() for i, t, _ in rows}
    for r in out.collect():
        got = r.text.split()
        words[r.doc_id] = words.get(r.doc_id, 0) + len(got)
        it = iter(texts[r.doc_id])
        assert all(w in it for w in got)  # in order, each once at most
    assert words == {i: n for i, n in taken.items() if n}


def test_equal_sources(spark):
    check(spark, [(i, prose(i, 50), f"s{i % 4}") for i in range(40)], 8)


def test_seats_are_highest_quotients(spark):
    votes = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.4, "e": 0.0}
    total, heap, want = 11, [(-v, k, 1) for k, v in votes.items()], dict.fromkeys(votes, 0)
    heapq.heapify(heap)
    for _ in range(total):
        _, k, n = heapq.heappop(heap)
        want[k] += 1
        heapq.heappush(heap, (-votes[k] / (2 * n + 1), k, n + 1))
    frame = spark.createDataFrame([(k, v, "x") for k, v in votes.items()], "party string, v double, one string")
    import pyspark.sql.functions as F

    got = mixture.seats(frame, F.col("v"), F.col("v") * total / sum(votes.values()), F.lit(100), F.lit(total), ["one"], ["party"])
    assert {r.party: r.seats for r in got.collect()} == want


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixture.mix(docs).count() == 0 and mixture.mixed(docs).count() == 0
