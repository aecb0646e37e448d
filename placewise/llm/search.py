"""Ranked lexical search, term at a time with a limited number of accumulators.

The terms of the queries are counted over all documents, which are reduced to the terms they share with a query. Each
task then takes its documents in shards. Within a shard the terms of a query come rarest first; each adds its part
to the accumulators of the documents that hold it. Once what the remaining terms can give at most is below the k-th best
score so far, a document without an accumulator can't come among the best any more: no accumulators are made from
there on, and those that can still reach that score are continued exactly. The k best of each task are
ranked together.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewise.llm.common import raw, word_runs, written

#: A term: a run of ASCII letters and digits and of characters beyond ASCII.
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of a shard; pairs of query and term that are searched at a time, about; groups in which the best of tasks are ranked first.
SHARD, PAIRS, SPREAD = 8192, 500_000, 256
NO_ID = (1 << 63) - 1
#: What makes the terms of UTF-8 bytes: other ASCII characters become spaces, A to Z small.
_TABLE = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))


def query_terms(text: Column) -> Column:
    """The terms of a text, in order, with repeats; null has none."""
    return F.regexp_extract_all(F.translate(text.cast("string"), UPPER, LOWER), F.lit(TERM), F.lit(0))


def tallied(text: bytes | None, known: dict[bytes, int]) -> tuple[int, list[int], list[int]]:
    """(number of terms, ascending known terms in the text, how often each)"""
    if text is None:
        return 0, [], []
    size, found = 0, Counter()
    for words in word_runs(text.translate(_TABLE), 0):
        size += len(words)
        found.update(filter(known.__contains__, words))
    mine = sorted((known[w], times) for w, times in found.items())
    return size, [t for t, _ in mine], [times for _, times in mine]


def index(docs: DataFrame, known: dict[bytes, int], id: str, text: str) -> DataFrame:
    """(doc_id, size, terms, times) of each document with a term: the numbers of the known terms in it, as
    32-bit integers, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = [tallied(t, known) for t in raw(x.column(1))]
            packed = [pa.array([np.array(r[k], "i4").tobytes() for r in rows], pa.binary()) for k in (1, 2)]
            out = pa.RecordBatch.from_arrays([x.column(0), pa.array([r[0] for r in rows], pa.int64()), *packed], ["doc_id", "size", "terms", "times"])
            yield out.filter(pa.array([r[0] > 0 for r in rows], pa.bool_()))

    return docs.select(F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, size long, terms binary, times binary")


def holders(indexed: DataFrame, known: int) -> np.ndarray:
    """The number of documents that hold each known term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(known, "i8")
        for x in batches:
            count += np.bincount(np.frombuffer(b"".join(x.column(0).to_pylist()), "i4"), minlength=known)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype("i4")), pa.array(count[some])], ["term", "n"])

    rows = indexed.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(known, "i8")
    out[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return out


class Shard:
    """Postings of some documents: for each term the ascending places of the documents that hold it, and what one
    occurrence of the term in a query gives them."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray, documents: int, length: int):
        self.ids = batch.column(0).to_numpy(zero_copy_only=False)
        size = batch.column(1).to_numpy(zero_copy_only=False)
        packed = batch.column(2).to_pylist()
        terms = np.frombuffer(b"".join(packed), "i4")
        times = np.frombuffer(b"".join(batch.column(3).to_pylist()), "i4").astype("i8")
        places = np.repeat(np.arange(len(size)), [len(p) // 4 for p in packed])
        m = 100 - 25 + 25 * size * documents // length
        order = np.argsort(terms, kind="stable")
        terms, self.places = terms[order], places[order]
        times = times[order]
        self.gains = weights[terms] * (1_000_000_000 * times // (1000 * times + 12 * m[self.places]))
        self.begin = np.searchsorted(terms, np.arange(len(weights) + 1))
        full = np.flatnonzero(np.diff(self.begin))
        self.most = np.zeros(len(weights), "i8")
        if len(full):
            self.most[full] = np.maximum.reduceat(self.gains, self.begin[full])

    def best(self, terms: np.ndarray, times: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, places) of the documents that can be among the k best with a score of ``least`` or more; terms
        are rarest first. All documents with such a score that belong to the k best are among them."""
        here = self.most[terms] > 0
        terms, times = terms[here], times[here]
        rest = np.concatenate([np.cumsum((self.most[terms] * times)[::-1])[::-1], [0]])  # from each term on
        sums = np.zeros(len(self.ids), "i8")
        at = 0
        while at < len(terms) and rest[at] >= least:
            own = slice(self.begin[terms[at]], self.begin[terms[at] + 1])
            sums[self.places[own]] += self.gains[own] * times[at]
            at += 1
            if len(sums) > k:
                least = max(least, int(np.partition(sums, -k)[-k]))
        live = np.flatnonzero((sums > 0) & (sums + rest[at] >= least))
        scores = sums[live]
        for i in range(at, len(terms)):
            if not len(live):
                break
            own = slice(self.begin[terms[i]], self.begin[terms[i] + 1])
            held = self.places[own]
            where = np.minimum(np.searchsorted(held, live), len(held) - 1)
            scores = scores + np.where(held[where] == live, self.gains[own][where] * times[i], 0)
            if len(scores) > k:
                least = max(least, int(np.partition(scores, -k)[-k]))
            stay = scores + rest[i + 1] >= least
            live, scores = live[stay], scores[stay]
        return scores, live


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _searched(docs: DataFrame, pairs: pa.Table, k: int, id: str, text: str) -> DataFrame:
    """(part, item_id, doc_id, score): the best of each task for the queries in ``pairs`` (item_id, term, times)."""
    terms = sorted(set(pairs["term"].to_pylist()))
    known = {t.encode(): i for i, t in enumerate(terms)}
    number = {t: i for i, t in enumerate(terms)}
    indexed = written(index(docs, known, id, text), "postings")
    documents, length = indexed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    held = holders(indexed, len(terms))
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(h) + 1))) for h in held], "i8")
    rows: dict = {}
    for item, term, times in zip(*(pairs[c].to_pylist() for c in ("item_id", "term", "times")), strict=True):
        rows.setdefault(item, []).append((int(held[number[term]]), number[term], times))
    asked = [(item, *(np.array(x, "i8") for x in list(zip(*sorted(r)))[1:])) for item, r in rows.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(np.zeros(0, "i8"), np.zeros(0, "i8"))] * len(asked)
        for x in batches:
            for begin in range(0, x.num_rows, SHARD):
                shard = Shard(x.slice(begin, SHARD), weights, documents, length)
                for i, (_, own, times) in enumerate(asked):
                    before = found[i]
                    least = int(before[0][-1]) if len(before[0]) == k else 1
                    scores, places = shard.best(own, times, k, least)
                    if len(scores):
                        found[i] = top(np.concatenate([before[0], scores]), np.concatenate([before[1], shard.ids[places]]), k)
        sizes = [len(s) for s, _ in found]
        items = pa.array([a[0] for a, n in zip(asked, sizes, strict=True) for _ in range(n)], pairs["item_id"].type)
        joined = [np.concatenate([f[j] for f in found] or [np.zeros(0, "i8")]) for j in (1, 0)]
        part = pa.array(np.full(len(items), TaskContext.get().partitionId() % SPREAD, "i4"))
        yield pa.RecordBatch.from_arrays([part, items, *map(pa.array, joined)], ["part", "item_id", "doc_id", "score"])

    kind = "long" if pa.types.is_int64(pairs["item_id"].type) else "string"
    return indexed.mapInArrow(run, f"part int, item_id {kind}, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = 20, id: str = "doc_id", text: str = "text", item: str = "item_id", asked: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest scores above 0 for each query, equal scores by
    ascending doc_id, a null one last.

    N documents have a term, L terms in all, n of them in one; a term that df documents hold weighs
    w = floor(1000 * ln((2N + 2) / (2df + 1))), and m = 75 + 25nN div L. The score sums, over the terms of the query with
    repeats, w * (10**9 * tf div (1000 * tf + 12m)).

    Null and empty texts have no terms: such queries give no rows and such documents are never found. Rows that repeat
    a doc_id are documents of their own; rows of one item_id, null included, are one query with the terms of all.
    Other columns aren't read. Texts are read whole. Queries are searched in blocks of about PAIRS (query, term) pairs,
    which go to every task; the bound holds unless one query has more terms than that.
    """
    kind = "long" if queries.schema[item].dataType.typeName() in ("byte", "short", "integer", "long") else "string"
    pairs = queries.select(F.col(item).cast(kind).alias("item_id"), F.explode(query_terms(F.col(asked))).alias("term"))
    pairs = written(pairs.groupBy("item_id", "term").agg(F.count("*").alias("times")), "queries")
    blocks = -(-pairs.count() // PAIRS)
    found = []
    for b in range(blocks):
        found.append(_searched(docs, pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow(), k, id, text))
    if not found:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionAll(more)
    order = [F.col("score").desc(), F.col("doc_id")]
    for keys in (["item_id", "part"], ["item_id"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return rows.select("item_id", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")
