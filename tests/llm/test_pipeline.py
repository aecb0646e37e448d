import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from placewise.llm import language, lines, simhash
from placewise.llm.common import written

from .test_lines import plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, "1234 !!", None, None, 7), (10**6 + 1, None, "en", "src1", None), (10**6 + 2, "", "en", None, 0)], docs.schema)
    out = [docs.unionAll(odd)]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), name))
    return out


def test_columns(steps):
    assert all(x.columns == steps[0].columns for x in steps[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "source_mix", "byte_bpe"]


def test_language_stage_keeps_documents_with_a_language(steps):
    kept = {r.doc_id for r in steps[1].collect()}
    assert kept == {r.doc_id for r in steps[0].collect()} - {10**6, 10**6 + 1, 10**6 + 2}
    assert language.UNKNOWN not in kept


def test_line_stage(steps):
    """Held against the brute force of the operator's tests on part of the documents, and against its result on all."""
    want = {r.doc_id: r.text for r in lines.without_repeated_lines(steps[1]).collect()}
    got = steps[2].collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_line_stage_against_brute_force(spark, steps):
    some = sorted(steps[1].collect(), key=lambda r: (len(r.text), r.doc_id))[:60]
    docs = spark.createDataFrame(some, steps[1].schema)
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, SF).collect()}
    assert got == {i: t for i, t, *_ in plain([(r.doc_id, r.text) for r in sorted(some, key=lambda r: r.doc_id)])}


NAMES = ("lang_pred", "score", "removed", "line_id", "line_tkey", "kept_id", "mix_id", "mix_hash", "mix_parts", "ids", "decoded")


def test_clashing_columns(spark):
    """Documents with a column for each name that a stage uses itself."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60)
    docs = docs.withColumns({n: F.lit(f"own {n}") for n in NAMES})
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = written(stage(spark, at, SF), name)
        assert at.columns == docs.columns and at.where(" OR ".join(f"{n} <> 'own {n}'" for n in NAMES)).count() == 0
    assert at.count() and corpus_pipeline.byte_bpe(spark, at, SF).count() == at.count()


def test_near_duplicate_stage(steps):
    groups = {}
    for r in steps[2].collect():
        fp = simhash.fingerprint(r.text.encode())
        mine = [g for g in groups if any((fp ^ f).bit_count() <= 2 for f in groups[g][1])]
        ids, fps = {r.doc_id}, {fp}
        for g in mine:
            ids, fps = ids | groups[g][0], fps | groups.pop(g)[1]
        groups[min(ids)] = (ids, fps)
    assert {r.doc_id for r in steps[3].collect()} == set(groups)


def test_mix_and_tokens(steps):
    before = {r.doc_id: Counter(r.text.split()) for r in steps[3].collect()}
    after = steps[4].collect()
    for r in after:
        assert not Counter(r.text.split()) - before[r.doc_id]
    assert max(Counter(r.doc_id for r in after).values()) <= 3
    want = Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in after)
    assert Counter((r.doc_id, r.decoded_sha256) for r in steps[5].collect()) == want


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
