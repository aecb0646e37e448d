import random
from collections import Counter

from placewise.llm import passages

from .helpers import clashing, frame, prose


def plain(rows, length):
    words = [[w for w in (t or "").translate({i: " " for i in range(9, 14)}).split(" ") if w] for _, t in rows]
    seen = Counter(tuple(w[k : k + length]) for w in words for k in range(len(w) - length + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                gone[k : k + length] = [True] * length
        out.append((str(i), len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(1)
    shared = [prose(100 + k, 60) for k in range(4)]
    rows = []
    for i in range(60):
        parts = [prose(i * 7 + k, rng.randint(1, 80)) for k in range(3)]
        at = rng.choice(shared).split()
        cut = rng.randint(0, 40)
        rows.append((i, " ".join([parts[0], *at[cut : cut + rng.choice([12, 34, 35, 36, 60])], parts[1], "\n", parts[2]])))
    rows += [(100, rows[5][1]), (101, rows[5][1]), (5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (None, shared[0])]
    rows += [(110, "a b " * 30), (111, "x " * 36), (112, "x " * 35), (113, "y " * 34), (114, None), (115, ""), (116, "few words"), (117, "few words"), (118, shared[1] + " " + shared[1])]
    rows += [(120, prose(9, 30_000)), (121, prose(9, 29_000))]
    for length in (35, 12):
        got = passages.without_repeats(clashing(spark, rows), length=length).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == plain(rows, length)


def test_empty(spark):
    assert passages.without_repeats(frame(spark, [])).count() == 0
