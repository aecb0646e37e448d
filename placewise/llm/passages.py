"""Repeated passages by seed and extend.

Seeds are winnowed anchors: of every ``length`` consecutive words, the smallest hash of ``SEED_WORDS``
consecutive words among them. It depends on those words alone, so equal passages share their anchors and
join on them; an anchor found at one place only proves the windows it stands for unique. Around the
others, matches are extended left and right as far as the length reaches: every window that the anchor
stands for is compared. Runs of repeated windows are the maximal repeats over the length.

Windows and seeds are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placewise.llm.common import raw, rolled, word_runs, written

SEED_WORDS = 8
NO_ID = -(1 << 63)


def word_ids(text: bytes | None) -> np.ndarray:
    """A 64-bit hash of each word."""
    digest = xxhash.xxh64_intdigest
    return np.concatenate([np.fromiter(map(digest, w), "u8", len(w)) for w in word_runs(text or b"", 0)])


def pooled(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Minimum or maximum of each run of ``width`` values, by doubling."""
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        x = pick(x[: len(x) - step], x[step:])
        reach += step
    return x


def own_anchors(ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(seed hashes by place, anchor of each window); needs ``length`` words."""
    seed = rolled(ids, SEED_WORDS)
    return seed, pooled(seed, length - SEED_WORDS + 1, np.minimum)


def anchor_places(ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchors, and the number of places where each stands."""
    seed, own = own_anchors(ids, length)
    edge = np.zeros(length - SEED_WORDS, "u8")
    at = pooled(np.concatenate([edge, own, edge]), length - SEED_WORDS + 1, np.maximum) == seed
    return np.unique(seed[at], return_counts=True)


def anchored_windows(ids: np.ndarray, shared: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each window whose anchor is among ``shared``."""
    start = np.flatnonzero(np.isin(own_anchors(ids, length)[1], shared))
    return start, rolled(ids, length)[start]


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that begins at one of ``starts``."""
    step = np.zeros(n + 1, "i8")
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return np.cumsum(step[:n]) > 0


def _keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, tkey, text): a row is told apart by its id and its text, so repeated and null ids do no harm."""
    text_ = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_).alias("tkey"), text_.alias("text"))


def _packed(keyed: DataFrame) -> DataFrame:
    """Texts compressed before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for x in batches:
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array([pack(t) for t in raw(x.column(2))], pa.binary())], ["id", "tkey", "packed"])

    return keyed.mapInArrow(run, "id long, tkey long, packed binary")


def repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = 35) -> DataFrame:
    """(id, tkey, whole, starts): rows with a repeated window of ``length`` words; tkey is the text's hash,
    id NO_ID for a null id. whole: the text stands in several rows, so all its windows are repeats.
    starts: else the first words (0-based, ascending) of its windows that also start elsewhere.

    Of equal texts one goes on to the comparison with others. Within an Arrow batch equal windows are
    settled at once and sent on as one, so a passage in a third of all documents costs the shuffle one
    row for each of its windows and batch. Anchors of one document are gathered per document only.
    """
    if length < SEED_WORDS:
        raise ValueError(f"length must be {SEED_WORDS} or more")
    keyed = _keyed(docs, id, text)

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows, found, places = [], [], []
            for i, t in enumerate(raw(x.column(2))):
                if len(ids := word_ids(t)) >= length:
                    anchor, n = anchor_places(ids, length)
                    found.append(anchor.view("i8"))
                    places.append(n)
                    rows.append(np.full(len(n), i))
            if found:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([x.column(0).take(at), x.column(1).take(at), pa.array(np.concatenate(found)), pa.array(np.concatenate(places))], ["id", "tkey", "anchor", "n"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for x in batches:
            rows, begin, found = [], [], []
            for i, (t, shared) in enumerate(zip(raw(x.column(2)), x.column(3), strict=True)):
                start, window = anchored_windows(word_ids(unpack(t)), shared.values.to_numpy().view("u8"), length)
                rows.append(np.full(len(start), i))
                begin.append(start.astype("i4"))
                found.append(window.view("i8"))
            rows, begin, found = map(np.concatenate, (rows, begin, found))
            if not len(rows):
                continue
            _, first, which, count = np.unique(found, return_index=True, return_inverse=True, return_counts=True)
            known = count[which] > 1  # settled here; the first of each also stands for it elsewhere
            key = np.where(known, x.column(1).to_numpy()[rows], found)
            alone = first[count > 1]
            ids, tkeys = x.column(0).to_numpy(), x.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[ids[rows], ids[rows[alone]]]),
                    pa.array(np.r_[tkeys[rows], tkeys[rows[alone]]]),
                    pa.array(np.r_[begin, begin[alone]]),
                    pa.array(np.r_[key, found[alone]]),
                    pa.array(np.r_[known, np.zeros(len(alone), bool)]),
                ],
                ["id", "tkey", "start", "window", "known"],
            )

    row = ["id", "tkey"]
    texts = keyed.select(*row, F.md5("text").alias("same"))
    classes = texts.groupBy("same").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1")
    copies = written(texts.join(classes, "same").select(*row, (F.col("id") > F.col("least")).alias("later")).distinct(), "copies")
    anchors = written(keyed.mapInArrow(seeds, "id long, tkey long, anchor long, n long"), "anchors")
    # A table of its own, so that the join deals both sides anew and AQE can split a hot anchor.
    shared = written(anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "shared")
    marked = anchors.join(shared, "anchor").groupBy(*row).agg(F.collect_set("anchor").alias("anchors"))
    marked = marked.join(copies.where("later"), row, "left_anti")
    every = _packed(keyed).join(marked, row).mapInArrow(windows, "id long, tkey long, start int, window long, known boolean")
    met = every.withColumn("n", F.count("*").over(Window.partitionBy("window", "known"))).where("known or n > 1")
    starts = met.groupBy(*row).agg(F.sort_array(F.collect_set("start")).alias("starts"))
    return starts.join(copies.select(*row, F.lit(True).alias("whole")), row, "full").select(*row, F.coalesce("whole", F.lit(False)).alias("whole"), "starts")


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each document without the words covered by a window of ``length``
    words that also starts anywhere else, itself included; the words left are joined by one space.

    Windows are judged on the input. Texts with fewer words than the length lose nothing, copies lose all.
    Null text counts as empty (kept is empty), rows with a null id stay, a repeated id is a document per
    row; only the id and text columns are read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for x in batches:
            total, gone, kept = [], [], []
            for packed, whole, starts in zip(raw(x.column(1)), x.column(2).to_pylist(), x.column(3), strict=True):
                runs = list(word_runs(unpack(packed), 0))
                n = sum(map(len, runs))
                if whole and n >= length:
                    drop = np.ones(n, bool)
                else:
                    drop = covered(starts.values.to_numpy() if starts.is_valid else np.zeros(0, "i4"), length, n)
                total.append(n)
                gone.append(int(drop.sum()))
                if not gone[-1]:
                    kept.append(b" ".join(b" ".join(r) for r in runs if r))
                    continue
                stay, parts, at = ~drop, [], 0
                for r in runs:
                    parts += [r[i] for i in np.flatnonzero(stay[at : at + len(r)]).tolist()]
                    at += len(r)
                kept.append(b" ".join(parts))
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    found = _packed(_keyed(docs, id, text)).join(repeats(docs, id, text, length), ["id", "tkey"], "left")
    found = found.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "packed", F.coalesce("whole", F.lit(False)).alias("whole"), "starts")
    return found.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
