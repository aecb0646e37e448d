"""SimHash near-duplicates by anchor-point covering.

Anchors are the codewords of a covering code of the 64-bit space: the product of two perfect binary
Golay codes (23 bits each, covering radius 3) and the zero word on the 18 bits left (radius 18). Every
fingerprint has a home anchor within the covering radius. It also visits every anchor, within radius
plus threshold, that is the home of some word at most ``distance`` bits away. Two fingerprints that
close therefore meet at the home of each, and only visitors and homes of one anchor are compared.
Both codes are linear, so the visited anchors differ from the home by a word that depends on the
syndrome alone: they come from one table of 2,048 rows, made from the generator polynomial.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.llm.common import components, raw, spare_names, word_runs, written

#: Generator polynomial of the binary Golay code of length 23, seed of the shingle hash.
GOLAY = 0b101011100011
SEED = 42
SHINGLE = 3


def fingerprint(text: bytes | None) -> int:
    """64 bits; bit i is set where over half of the shingle hashes have it. No words: zero."""
    total, ones, few = 0, np.zeros(64, "i8"), []
    digest = xxhash.xxh64_intdigest
    for words in word_runs((text or b"").lower(), SHINGLE - 1):
        n = len(words)
        if n < SHINGLE:
            few = few or words
            continue
        joined = b" ".join(words)
        size = np.fromiter(map(len, words), "i8", n)
        begin = np.cumsum(size + 1) - size - 1
        first, last = begin[: 1 - SHINGLE].tolist(), (begin + size)[SHINGLE - 1 :].tolist()
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(first, last, strict=True)], "<u8")
        for k in range(0, len(h), 1 << 15):
            ones += np.unpackbits(h[k : k + (1 << 15)].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
        total += len(h)
    if not total:
        if not few:
            return 0
        total, ones = 1, np.unpackbits(np.array([digest(b" ".join(few), SEED)], "<u8").view("u1"), bitorder="little").astype("i8")
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            fps = np.array([fingerprint(t) for t in raw(x.column(1))], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rest: remainder of the high 12 bits; fix: the error of each syndrome (weight 3 at most);
    away: for each syndrome and each number of flips 0, 1, 2 the differences between the home's
    12 message bits and those of homes that so many flips reach and fewer don't; -1 pads."""

    def remainder(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GOLAY << (i - 11)
        return x

    unit = [remainder(1 << i) for i in range(23)]
    rest = np.array([remainder(h << 11) for h in range(4096)])
    fix = np.zeros(2048, "i8")
    flips = [[(0, 0)], [(1 << i, unit[i]) for i in range(23)], [(1 << i | 1 << j, unit[i] ^ unit[j]) for i, j in combinations(range(23), 2)]]
    for m in (1, 2, 3):
        for at in combinations(range(23), m):
            s = e = 0
            for i in at:
                s, e = s ^ unit[i], e | 1 << i
            fix[s] = e
    rows = []
    for s in range(2048):
        seen: set[int] = set()
        rows.append([])
        for some in flips:
            new = {int(fix[s] ^ e ^ fix[s ^ t]) >> 11 for e, t in some} - seen
            seen |= new
            rows[-1].append(sorted(new))
    away = np.full((3, 2048, max(len(x) for r in rows for x in r)), -1)
    for s, r in enumerate(rows):
        for c, some in enumerate(r):
            away[c, s, : len(some)] = some
    return rest, fix, away


def anchors(fp: np.ndarray, distance: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) of every anchor that each fingerprint (u8) visits, its home included."""
    rest, fix, away = golay()
    homes, synd = [], []
    for shift in (0, 23):
        x = (fp >> np.uint64(shift)).astype("i8") & 0x7FFFFF
        s = rest[x >> 11] ^ (x & 0x7FF)
        homes.append((x ^ fix[s]) >> 11)
        synd.append(s)
    row, anchor, home = [], [], []
    for c in range(distance + 1):
        for d in range(distance + 1 - c):
            one, two = away[c][synd[0]], away[d][synd[1]]
            one, two = one[:, (one >= 0).any(0)], two[:, (two >= 0).any(0)]
            keep = (one >= 0)[:, :, None] & (two >= 0)[:, None, :]
            key = (homes[0][:, None] ^ one)[:, :, None] << 12 | (homes[1][:, None] ^ two)[:, None, :]
            row.append(np.nonzero(keep)[0])
            anchor.append(key[keep])
            home.append(np.full(len(row[-1]), c + d == 0))
    return np.concatenate(row), np.concatenate(anchor), np.concatenate(home)


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b), a < b: pairs of distinct fingerprints (column fp) at ``distance`` (0 to 2) or fewer differing
    bits, each once or more. A word has at most 2,080 others that near, so output is linear in the input.
    Anchors that many fingerprints visit are split by AQE's skew join."""
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            fp = x.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(fp), 2048):
                own = fp[k : k + 2048]
                row, anchor, home = anchors(own.view("u8"), distance)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.astype("i4")), pa.array(own[row]), pa.array(home)], ["anchor", "fp", "home"])

    at = fps.select("fp").mapInArrow(run, "anchor int, fp long, home boolean")
    homes = at.where("home").select("anchor", F.col("fp").alias("b"))
    visitors = at.select("anchor", F.col("fp").alias("a"))
    # Visitors are many more than Spark expects of the fingerprints: never broadcast them.
    return homes.join(visitors.hint("merge"), (homes.anchor == visitors.anchor) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", distance: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): texts whose fingerprints are linked, directly or over others,
    share the smallest doc_id reachable.

    Null and wordless texts have fingerprint zero and are linked by it like any other. A repeated doc_id
    keeps its rows; each has its own text's fingerprint. Null ids stay, and never name a component (a group
    of null ids only has component null). Only the id and text columns are read, so further columns may have
    any name. An empty table gives no rows. Texts are read in runs, so their length is not bounded.
    """
    own = written(fingerprints(docs, id, text), "fingerprints")
    classes = written(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    groups = components(links(classes, distance))
    classes = classes.join(groups, classes.fp == groups.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    classes = written(classes, "grouped")
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    found = classes.join(least, "component").select("fp", "component_id")
    return own.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", distance: int = 2) -> DataFrame:
    """The documents without near copies: of each group the one with the smallest id stays, with all columns.
    Rows that repeat an id are one document and stay together; rows with a null id stay, and so do further columns,
    whatever their names."""
    found = near_duplicates(docs, id, text, distance)
    (kept_id,) = spare_names(docs, "kept_id")
    keys = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(kept_id)).distinct()
    kept = docs.join(keys, F.col(id).cast("long") == F.col(kept_id), "left_semi")
    return kept.unionByName(docs.where(F.col(id).isNull()))
