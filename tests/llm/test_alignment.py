import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from placewise.llm import alignment, bpe, pieces, queries

from .helpers import frame, prose

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
BYTE_OF = {c: b for b, c in enumerate(bpe.byte_characters())}


def tokens(text):
    """[(id, bytes)] of A and of B, or None if they don't join to the space and the text."""
    if not text:
        return None
    a = [(i, bytes(BYTE_OF[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()) for i in B.encode(text) for p in [B.id_to_piece(i)]]
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else None


def plain(rows):
    made = []
    for i, text in rows:
        found = tokens(text)
        if found is None:
            made.append((i, [], [], None))
            continue
        ends = [np.cumsum([len(x) for _, x in f]).tolist() for f in found]
        at = {e: q for q, e in enumerate(ends[1])}
        links = [(p, at[e]) for p, e in enumerate(ends[0]) if e in at]
        groups, p0, q0 = [], 0, 0
        for p, q in links:
            groups.append(",".join(str(t) for t, _ in found[0][p0 : p + 1]) + "|" + ",".join(str(t) for t, _ in found[1][q0 : q + 1]))
            p0, q0 = p + 1, q + 1
        made.append((i, [(found[0][p][0], found[1][q][0]) for p, q in links], groups, found))
    count = Counter(pair for _, links, *_ in made for pair in links)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return sorted(
        (
            (i, len(f[0]) if f else 0, len(f[1]) if f else 0, len(g), len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if f else "")
            for i, x, g, f in made
        ),
        key=str,
    )


def found(spark, rows):
    return sorted((tuple(r) for r in alignment.align(frame(spark, rows)).collect()), key=str)


ODD = [None, "", " ", "a", "  two  spaces ", "\n\n x\t", "a▁b", "<|endoftext|></s><0x0A>", "😀é漢字 ﬁ x", "naïve cafés l'été 1234567", "<unk>", "﻿"]


def documents():
    rng = random.Random(2)
    rows = [*enumerate(ODD), (None, "null id"), (3, "again"), (3, "again")]
    return rows + [(100 + k, " ".join("".join(rng.choices("etaonîß.,9", k=rng.randint(1, 9))) for _ in range(rng.randint(1, 80)))) for k in range(40)] + [(200, prose(1, 5000))]


@pytest.mark.parametrize("rows,characters,work", [(4096, 1 << 22, 1 << 16), (3, 200, 7), (1, 1, 1)])
def test_against_brute_force(spark, monkeypatch, rows, characters, work):
    monkeypatch.setattr(alignment, "ROWS", rows)
    monkeypatch.setattr(alignment, "CHARACTERS", characters)
    monkeypatch.setattr(alignment, "WORK", work)
    assert found(spark, documents()) == plain(documents())


def test_merge_path():
    rng = np.random.default_rng(1)
    for _ in range(300):
        end = int(rng.integers(1, 60))
        a, b = (np.append(np.flatnonzero(rng.random(end - 1) < share) + 1, end) for share in rng.random(2))
        links = [(int(np.flatnonzero(a == e)[0]), int(np.flatnonzero(b == e)[0])) for e in np.intersect1d(a, b)]
        ends = np.union1d(a, b)
        want = [(int((a < e).sum()), int((b < e).sum())) for e in ends]
        for work in (1, 2, 3, 8, 1000):
            path = alignment.diagonals(a, b, work)
            assert path[0].tolist() == [0, 0] and path[-1].tolist() == [len(a), len(b)] and np.diff(path.sum(1)).max(initial=0) <= work
            assert list(zip(*(x.tolist() for x in alignment.closes(a, b, work)))) == links
            assert [p for x, y, _ in alignment.overlaps(a, b, work) for p in zip(x.tolist(), y.tolist())] == want


def test_edges(spark):
    assert found(spark, []) == []
    docs = spark.createDataFrame([(1, "some text", 5, "x"), (2, None, 6, "y")], "doc_id long, text string, block int, own string")
    assert sorted(tuple(r) for r in alignment.align(docs).collect()) == plain([(1, "some text"), (2, None)])


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted((tuple(r) for r in queries.op13_token_alignment(spark, sf).collect()), key=str)
    assert got == plain([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=("Cs",)), st.sampled_from(" '.,!a1sT\n\tłé×€—")), max_size=40))
def test_cuts_change_no_token(text):
    own = alignment.codecs(Path(alignment.DEFAULT_A).read_text(), pieces.read_model())
    assert np.frombuffer(own[0].encode([text])[0], "u4").tolist() == A.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own[1].encode([text])[0], "u4").tolist() == B.encode(text)
