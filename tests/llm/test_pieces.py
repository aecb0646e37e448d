import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from placewise.llm import pieces, queries

from .helpers import frame

LIBRARY = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
OWN = pieces.Codec(pieces.read_model())
ODD = ["", " ", "a", "  a  b ", "\n", "\n\n a\n", "▁x", "\x00a", "a\tb\r\n", "é́", "😀 x", "<0x41>", "</s>x", "﻿x", "ﬁ", " " * 40, "a" * 100, "ab" * 77, "  \n   \n", "x" + " " * 17 + "y", "漢字かな交じり文" * 9, "⁇ ⁇", "0" * 33 + " 00000", "hahaha hahahaha", "." * 50 + "!" * 20]


def ids(texts):
    return [np.frombuffer(x, "u4").tolist() for x in OWN.encode(texts)]


def test_pieces_joined_at_random():
    rng = random.Random(3)
    known = list(OWN.texts)
    texts = ["".join(rng.choice(known) for _ in range(rng.randint(1, 6))) for _ in range(5000)]
    texts += ["".join(rng.choice("  aeth\n.é9") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    assert ids(texts) == LIBRARY.encode(texts)


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_any_text(text):
    found = ids([text])[0]
    assert found == LIBRARY.encode(text)
    assert OWN.decode([*found, OWN.end]) == LIBRARY.decode([*found, OWN.end])


def test_steps_back_over_long_runs():
    """Texts without a cut, where the longest matches are often wrong, also when nothing else is kept."""
    rng = random.Random(4)
    texts = ["".join(rng.choice(("tion", "ation", "er", "r", "e", "the", "h")) for _ in range(4000)), "a" * 20_001, "e" * 999 + "r" * 999]
    assert ids(texts) == LIBRARY.encode(texts)
    assert [OWN.encode_cut(" " + t) for t in texts] == LIBRARY.encode(texts)


def test_pieces_that_merging_never_makes():
    """Neighbours that fit are those that the library keeps apart."""
    rng = random.Random(5)
    some = rng.sample(sorted(OWN.ids), 3000)
    for a, b in zip(some, some[1:]):
        text = (a + b).removeprefix(" ") if a[0] == " " else None
        if text is not None and a != " ":
            assert OWN.fit(OWN.ids[a], OWN.ids[b]) == (LIBRARY.encode(text) == [OWN.ids[a], OWN.ids[b]])


def test_decode_of_any_ids():
    rng = random.Random(6)
    for _ in range(2000):
        some = [rng.choice((rng.randrange(32_000), rng.randrange(3, 259), 1, 2)) for _ in range(rng.randint(0, 5))]
        assert OWN.decode(some) == LIBRARY.decode(some), some


def test_generations_and_stretches(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 50)
    monkeypatch.setattr(pieces, "STRETCH", 300)
    monkeypatch.setattr(pieces, "PAIRS", 20)
    own, rng = pieces.Codec(pieces.read_model()), random.Random(7)
    texts = [" ".join("".join(rng.choices("etaoin", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    assert [np.frombuffer(x, "u4").tolist() for x in own.encode(texts)] == LIBRARY.encode(texts)


def test_operator(spark):
    rows = [(k, t) for k, t in enumerate(ODD) if "\x00" not in t] + [(None, "null id"), (7, None), (7, "again"), (7, "again")]
    docs = spark.createDataFrame([(i, t, [1], "x", 3) for i, t in rows], "doc_id long, text string, ids array<int>, decoded string, n_tokens int")
    got = pieces.decode(pieces.encode(docs)).collect()
    want = [(i, [*LIBRARY.encode(t or ""), 2]) for i, t in rows]
    assert sorted((str(r.doc_id), r.ids, r.n_tokens, r.decoded) for r in got) == sorted((str(i), x, len(x), LIBRARY.decode(x)) for i, x in want)
    assert pieces.encode(frame(spark, [])).count() == 0
    assert pieces.encode(frame(spark, [(1, "a b")]), end=False).first().ids == LIBRARY.encode("a b")
    with pytest.raises(ValueError):
        pieces.decode(docs)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op12_sentencepiece(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(docs) == len(got)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in docs:
        want = LIBRARY.encode(r.text or "", add_eos=True)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (len(want), digest(" ".join(map(str, want))), digest(LIBRARY.decode(want)))
