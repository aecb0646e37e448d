import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from placewise.llm import quality

from .helpers import prose

SCHEMA = "doc_id long, text string, lang string, log_ppl string, kept string, n string"


def documents(n=60):
    rng = random.Random(1)
    rows = [(i, prose(i, rng.randint(40, 200)) + rng.choice(["", "\nfoot note\nfoot note", " ### %$"]), rng.choice(["en", "fr", None])) for i in range(n)]
    rows += [(200, None, "en"), (201, "", "en"), (202, "one two", "de"), (203, "a b c " * 60, "en"), (204, "x" * 3000, "en"), (None, prose(1, 90), "en"), (3, prose(2, 90), "fr"), (205, "é　ü " * 80, "fr")]
    return rows


def base(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    hit = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def log_perplexities(rows, order):
    texts = [(lang or "und", " ".join((t or "").encode().split() and [w.decode() for w in (t or "").encode().split()] or [])) for _, t, lang in rows]
    counts = defaultdict(Counter)
    for lang, t in texts:
        counts[lang].update(t[k : k + order] for k in range(len(t) - order + 1))
    p, back, gone = {}, {}, set()
    for lang, top in counts.items():
        tables = {order: top}
        for n in range(order - 1, 0, -1):
            tables[n] = Counter(g[1:] for g in tables[n + 1])
        p[lang, ""] = 1 / (len(tables[1]) + 1)
        for n in range(1, order + 1):
            c = tables[n]
            k = [sum(v == x for v in c.values()) for x in (1, 2, 3, 4)]
            d = [0.5, 1.0, 1.5]
            if min(k):
                y = k[0] / (k[0] + 2 * k[1])
                d = [min(max(0, x - (x + 1) * y * k[x] / k[x - 1]), x) for x in (1, 2, 3)]
            total, cut = Counter(), Counter()
            for g, v in c.items():
                total[g[:-1]] += v
                cut[g[:-1]] += d[min(v, 3) - 1]
            for g, v in c.items():
                p[lang, g] = (v - d[min(v, 3) - 1] + cut[g[:-1]] * p[lang, g[1:]]) / total[g[:-1]]
                back[lang, g[:-1]] = cut[g[:-1]] / total[g[:-1]]
            gone |= {(lang, g) for g, v in c.items() if n > 1 and v < 2}

    def score(lang, g):
        return back[lang, g[:-1]] * score(lang, g[1:]) if (lang, g) in gone else p[lang, g]

    out = []
    for lang, t in texts:
        m = len(t) - order + 1
        out.append(-sum(math.log(score(lang, t[k : k + order])) for k in range(m)) / m if m > 0 else None)
    return out


def test_against_brute_force_on_both_paths(spark):
    rows = documents()
    docs = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)
    want = sorted((str(i), *base(t), None if p is None else round(p, 4)) for (i, t, _), p in zip(rows, log_perplexities(rows, quality.ORDER), strict=True))
    verdicts = []
    for limit in (quality.BROADCAST_ROWS, 0):
        got = quality.judge(docs, broadcast_rows=limit).collect()
        assert sorted(((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, None if r.log_ppl is None else round(r.log_ppl, 4)) for r in got), key=str) == sorted(want, key=str)
        for r in got:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert r.kept == (not r.base_failed and r.low <= r.log_ppl <= r.high)
        verdicts.append(sorted((str(r.doc_id), r.n_words, r.kept) for r in got))
    assert verdicts[0] == verdicts[1] and any(v[2] for v in verdicts[0])


def test_unseen_ngrams_back_off(spark):
    docs = spark.createDataFrame([((i, i), "en", prose(i, 300)) for i in range(5)], "key struct<id:int,tkey:int>, lang string, text string")
    grams, contexts = quality.kneser_ney(quality.gram_counts(docs))
    new = spark.createDataFrame([((9, 9), "en", "w1 never w2 ž w3"), ((8, 8), "xx", "w1 w2 w3 w4"), ((7, 7), "en", "w1")], docs.schema)
    one, other = ({r.key.id: r.log_ppl for r in quality.scored(new, grams, contexts, broadcast_rows=n).collect()} for n in (10**6, 0))
    assert math.isclose(one[9], other[9], rel_tol=1e-5) and one[9] > 0
    assert one[8] is other[8] is one[7] is other[7] is None


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([("en", prose(1, 500))], "lang string, text string")
    grams, contexts = quality.kneser_ney(quality.gram_counts(docs, 2), 2)
    p, b = ({r.gram: math.exp(r[-1]) for r in x.collect()} for x in (grams, contexts))
    letters = [g for g in p if len(g) == 1]
    for context in letters[:10]:
        seen = sum(p[context + x] for x in letters if context + x in p)
        unseen = sum(b[context] * p[x] for x in letters if context + x not in p)
        rest = b[context] * b[""] * p[""]  # the unknown character
        assert math.isclose(seen + unseen + rest, 1, abs_tol=1e-6)


def test_bands_and_noise(spark):
    rng = np.random.default_rng(1)
    some = random.Random(2)
    syllables = lambda: "".join(some.choice(["ka", "to", "mi", "re", "sun", "al"]) for _ in range(some.randint(1, 4)))
    rows = [(i, " ".join(syllables() for _ in range(150)), "en") for i in range(200)] + [(999, " ".join("".join(map(chr, rng.integers(0x400, 0x450, 5))) for _ in range(150)), "en")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[999].base_failed and not got[999].kept and sum(r.kept for r in got.values()) >= 196


def test_empty(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
