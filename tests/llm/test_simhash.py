import random

import numpy as np
import xxhash

from placewise.llm import simhash

from .helpers import clashing, frame, groups, prose


def plain(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, prose(i, 80)) for i in range(60)]
    for i in range(60, 140):
        words = rows[rng.randrange(60)][1].split()
        words[rng.randrange(len(words))] = f"new{i}"
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "One"), (204, "one"), (205, "one two"), (206, "É one"), (207, "é one"), (208, rows[0][1].upper()), (None, rows[0][1]), (3, rows[3][1])]
    rows.append((209, prose(9, 60_000)))
    fp = [plain(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if bin(fp[a] ^ fp[b]).count("1") <= 2]
    g = groups(range(len(rows)), links)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[g[k]] = min(x for x in (least.get(g[k]), i) if x is not None)
    want = sorted((str(i), f"{fp[k]:016x}", least[g[k]]) for k, (i, _) in enumerate(rows))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(clashing(spark, rows)).collect()) == want


def test_anchors_meet():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2**64, 500, dtype="u8")
    row, anchor, _ = simhash.anchors(x)
    visits = [set(anchor[row == i].tolist()) for i in range(len(x))]
    for bits in (0, 1, 2):
        y = x.copy()
        for _ in range(bits):
            y ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype("u8")
        _, home, is_home = simhash.anchors(y)
        assert all(h in v for h, v in zip(home[is_home].tolist(), visits, strict=True))


def test_long_text_in_runs(monkeypatch):
    text = prose(1, 5000)
    whole = simhash.fingerprint(text.encode())
    runs = simhash.word_runs
    monkeypatch.setattr(simhash, "word_runs", lambda t, c: runs(t, c, 100))
    assert simhash.fingerprint(text.encode()) == whole


def test_keep_one_and_empty(spark):
    docs = clashing(spark, [(5, "a b c d"), (2, "a b c d"), (None, "a b c d"), (9, "q r s t u")])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "9", "None"]
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
