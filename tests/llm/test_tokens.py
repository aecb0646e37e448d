import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from placewise.llm import bpe, counts

from .helpers import clashing, frame, prose

BITS = ["ab", " ", "  ", "\n", "\r\n", "\t", "1", "23", "'s", ".", "...", "é", "中", "😀", "\xa0", "_", "<|endoftext|>", "\x1c", "x" * 40]


@pytest.fixture(scope="module")
def known():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.DEFAULT_RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 15))) for _ in range(n)]


def test_encode_decode_and_spans(spark, known):
    texts = [*random_texts(300), None, "", prose(2, 20_000), "word" * 5000, " " * 3000]
    rows = bpe.decode(bpe.encode(clashing(spark, list(enumerate(texts))), offsets=True)).collect()
    for r in rows:
        text, ids = texts[r.doc_id] or "", np.frombuffer(r.ids, "<u4").tolist()
        assert ids == known(text) and r.n_tokens == len(ids) and bytes(r.decoded) == text.encode()
        token = [bytes(bpe.codec(bpe.read_ranks()).decode(np.array([i], "<u4").tobytes())) for i in ids[:50]]
        at = 0
        for piece, begin, end in zip(token, r.begin, r.end, strict=False):
            assert text[begin:end].encode().find(piece) >= 0 and len(text[:begin].encode()) <= at < len(text[:end].encode())
            at += len(piece)


def test_unknown_ids_and_small_cache(known, monkeypatch):
    own = bpe.Codec(bpe.read_ranks())
    assert own.decode(np.array([50256, 2**32 - 1], "<u4").tobytes()) == "��".encode()
    monkeypatch.setattr(bpe, "KEPT", 3)
    monkeypatch.setattr(bpe, "STRETCH", 10)
    texts = random_texts(200, 2)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [known(t) for t in texts]


def test_empty(spark):
    assert bpe.decode(bpe.encode(frame(spark, []))).count() == 0
    assert counts.recount(counts.index(frame(spark, [])).withColumn("edits", F.array().cast(counts.EDITS))).count() == 0


def test_edits_keep_counts_right(known, monkeypatch):
    rng = random.Random(3)
    own = bpe.codec(bpe.read_ranks())
    for k in range(1500):
        monkeypatch.setattr(counts, "LEAF", rng.choice([3, 20, 100]))
        text = prose(k, rng.randint(0, 200)) if k % 2 else "".join(random_texts(4, k))
        doc = counts.Document(own, text)
        for _ in range(rng.randint(1, 4)):
            begin = rng.randint(0, len(text))
            end = min(len(text), begin + rng.choice([0, 0, 1, 2, 30, 400]))
            new = rng.choice(["", "x", " ", "  y", "foo bar", "\xa0", "\n", "9", " it's"])
            doc.edit(begin, end, new)
            text = text[:begin] + new + text[end:]
        assert "".join(doc.leaves) == text and doc.tokens == len(known(text))


def test_recount(spark, known):
    texts = [prose(1, 3000), None, "short one", ""]
    log = [(0, 10, 20, "new words"), (0, 15, 18, "lost"), (0, 10, 20, "new words"), (0, 9000, 10**6, None), (0, -5, 3, "A "), (1, 0, 4, "text"), (2, None, 1, "x"), (2, 5, 2, "é")]
    edits = counts.gathered(spark.createDataFrame(log, "doc_id long, begin int, end int, text string"))
    base = counts.index(clashing(spark, list(enumerate(texts))))
    rows = {r.doc_id: r for r in counts.recount(base.join(edits, "doc_id", "left")).collect()}
    first = texts[0]
    after = "A " + first[3:10] + "new words" + first[20:9000]
    assert (rows[0].n_tokens, rows[0].n_tokens_after, rows[0].n_edits, rows[0].chars_after) == (len(known(first)), len(known(after)), 3, len(after))
    assert rows[0].chars_encoded < 2000
    assert (rows[1].n_tokens, rows[1].n_tokens_after) == (0, len(known("text")))
    assert (rows[2].n_tokens_after, rows[2].n_edits) == (len(known("shorté one")), 1)
    assert (rows[3].n_tokens_after, rows[3].n_edits) == (0, 0)
