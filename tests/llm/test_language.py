import zlib

import numpy as np

from placewise.llm import language

from .helpers import frame

SCHEMA = "doc_id long, text string, lang string, lang_pred string"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    rows = [(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de", "") for i in range(40)]
    rows += [(100, None, "en", ""), (101, "", "de", ""), (102, "123 !? \n", None, ""), (103, "the dog", None, ""), (None, "die katze", "de", ""), (1, "the cat", "en", ""), (104, "der hund " * 200_000, None, "")]
    out = language.language_id(frame(spark, rows, SCHEMA))
    assert out.count() == len(rows)
    got = {r.doc_id: (r.lang_pred, r.score) for r in out.collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0)
    assert got[103][0] == "en" and got[104][0] == "de" and got[None][0] == "de"


def test_nothing_to_learn(spark):
    assert language.language_id(frame(spark, [], SCHEMA)).count() == 0
    assert language.language_id(frame(spark, [(1, "words", None, "")], SCHEMA)).first().lang_pred == "und"


def test_bounded_sample(spark):
    rows = [(i, "abc def", "en" if i % 10 else "de", "") for i in range(2000)]
    model = language.fit(frame(spark, rows, SCHEMA), sample=100)
    assert model.languages == ("de", "en")


def test_learns_from_all_rows(spark):
    """25,000 rows of a language: each is counted."""
    rows = spark.range(25_000).selectExpr("id AS doc_id", "'abc def' AS text", "'en' AS lang")
    model = language.fit(rows)
    counts = 25_000 * language.grams("abc def") + language.SMOOTHING
    assert np.allclose(model.weights[:, 0], np.log(counts / counts.sum()), rtol=0, atol=1e-12)
