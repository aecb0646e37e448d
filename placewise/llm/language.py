"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts per language and bucket come from all labelled rows, summed in each task first. The matrix of log
probabilities (languages x buckets, both bounded) goes to every task; a text's sparse n-gram counts are
multiplied with it in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.llm.common import lean

#: Fixed limits. Buckets of the hash, n-gram lengths, most languages, additive smoothing.
BUCKETS, GRAMS, MAX_LANGUAGES, SMOOTHING = 1 << 15, (1, 2, 3), 100, 0.5
UNKNOWN = "und"
PIECE = 1 << 20


@lru_cache(1)
def folded() -> np.ndarray:
    """For each code point its lower-case letter, or a space if it isn't a letter."""
    out = np.full(0x110000, 0x20, "u4")
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(text: str) -> np.ndarray | None:
    """Counts per bucket of the whole text's n-grams; None without a letter. Runs of other characters are
    one space, and the text stands between spaces."""
    total = None
    for k in range(0, len(text), PIECE):  # long texts piece by piece, with no n-gram across the seam
        codes = folded()[np.frombuffer(text[k : k + PIECE].encode("utf-32-le", "surrogatepass"), "<u4")]
        codes = np.concatenate([[0x20], codes, [0x20]]).astype("u4")
        codes = codes[np.r_[True, (codes[1:] != 0x20) | (codes[:-1] != 0x20)]]
        if len(codes) < 2:
            continue
        h, all_ = np.zeros(len(codes), "u4"), []
        for n in range(1, max(GRAMS) + 1):
            h = (h[: len(codes) - n + 1] ^ codes[n - 1 :]) * np.uint32(0x9E3779B1)
            if n in GRAMS:
                mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)
                all_.append(mixed >> np.uint32(32 - BUCKETS.bit_length() + 1))
        counts = np.bincount(np.concatenate(all_), minlength=BUCKETS)
        total = counts if total is None else total + counts
    return total


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # log probabilities, buckets x languages
    prior: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, posterior probability)."""
        counts = grams(text) if text and self.languages else None
        if counts is None:
            return UNKNOWN, 0.0
        at = np.flatnonzero(counts)
        score = counts[at] @ self.weights[at] + self.prior
        best = int(score.argmax())
        return self.languages[best], float(1 / np.exp(score - score[best]).sum())


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int | None = None) -> Model:
    """A model of all rows with text and lang; if told so, of about ``sample`` rows of a language with more, by the
    hash of their key. Whole texts are counted. Ties between languages go to the first by
    name. More than MAX_LANGUAGES languages are an error, since the model is held in memory."""
    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.col(key).alias("key")).where("text is not null and lang is not null")
    number = dict(rows.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect())
    if len(number) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not number:
        return Model((), np.zeros((BUCKETS, 0)), np.zeros(0))
    languages = tuple(sorted(number))
    if sample is not None:
        rate = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample / number[lang]))])[F.col("lang")]
        rows = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < rate * (1 << 20))
    place = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(languages), BUCKETS), "i8")
        for x in batches:
            for t, lang in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                if (counts := grams(t)) is not None:
                    sums[place[lang]] += counts
        i, j = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(sums[i, j])], ["lang", "bucket", "n"])

    counts = np.full((BUCKETS, len(languages)), SMOOTHING)
    found = rows.select("text", "lang").mapInArrow(run, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    for i, j, n in found.toLocalIterator():  # languages x buckets rows at most
        counts[j, i] += n
    prior = np.array([float(number[x]) for x in languages])
    return Model(languages, np.log(counts / counts.sum(0)), np.log(prior / prior.sum()))


def predict(docs: DataFrame, model: Model, text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with ``label`` and ``score`` (0 to 1, the posterior), columns that it doesn't have yet. Null texts and
    texts without a letter get UNKNOWN and 0, and so does every text where nothing could be learned. Only the text is
    looked at."""
    taken = {label, score} & set(docs.columns)
    if taken:
        raise ValueError(f"columns already there: {sorted(taken)}")
    at = docs.columns.index(text)
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS x MAX_LANGUAGES doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for x in batches:
            found = [held.value.predict(t) for t in x.column(at).cast(pa.string()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*x.schema.names, label, score])

    return docs.mapInArrow(run, docs.withColumns({label: F.lit(""), score: F.lit(0.0)}).schema)


def held_out(id: Column) -> Column:
    """Whether crc32 of the id as text is a multiple of 5; such rows are not learned from. Null ids are not held out."""
    return F.coalesce(F.crc32(id.cast("string")) % 5 == 0, F.lit(False))


def language_id(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learned from the labelled rows that aren't held out.

    Null and letterless texts are UNKNOWN with score 0; null labels are not learned from; repeated ids keep
    their rows. Other columns are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col(id).alias("doc_id"), held_out(F.col(id)).alias("held_out"), F.col(text).cast("string").alias("text"), F.col(lang).alias("lang"))
    model = fit(rows.where("not held_out"))
    return predict(rows.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
