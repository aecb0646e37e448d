"""Alignment of two tokenizers' tokens by merging their ends along a merge path.

Both tokenizers cut the same bytes, so their tokens are two ascending lists of ends. Merging the lists is a path through
a grid; a diagonal of the grid cuts it where binary search says, so the diagonals at equal distances part the work
into equal pieces that need nothing of each other. A piece emits the overlaps between two neighbouring ends and
marks those where both tokens end. Pieces are stitched where equal ends, or a group, lie on both sides of a
diagonal. The links of id pairs are counted over the corpus: each block of documents sends its distinct pairs once and
gets their counts back.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from placewise.llm import bpe, pieces
from placewise.llm.common import written

DEFAULT_A, DEFAULT_B = public_tokenizers.path("byte_bpe_50k.json"), pieces.DEFAULT_MODEL

#: Ends that a piece merges; rows and characters of a block, unless one text has more.
WORK, ROWS, CHARACTERS = 1 << 16, 4096, 1 << 22
#: Distinct cuts kept by a worker in each of two generations.
KEPT = 300_000


#: White space with signs and letters after it that end before a sign or white space, or with all up to white space. No
#: match of the tokenizer's pattern goes on from a letter to an ASCII sign or digit.
_SPACE, _SIGN, _LETTER = " \\t-\\r", "!-@[-`{-~", "A-Za-zÀ-ÖØ-öø-ÿ"
_CUT = re.compile(f"[{_SPACE}]*[{_SIGN}]*[{_LETTER}]+(?=[{_SPACE}{_SIGN}]|\\Z)|[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


class ByteLevel(bpe.Codec):
    """Byte-level BPE from a tokenizer file; strings of its special tokens are ordinary text."""

    def __init__(self, file: str):
        self.tokenizer = Tokenizer.from_str(file)
        self.tokenizer.encode_special_tokens = True
        bpe.Tables.__init__(self, self.tokenizer.get_vocab())
        self.cache, self.old = {}, {}

    def pieces(self, texts: list[str]) -> tuple[list[str], list[int]]:
        out, count = [], []
        for t in texts:
            new = [t] if bpe._WIDE.search(t) else _CUT.findall(t)
            out += new
            count.append(len(new))
        return out, count

    def encode_pieces(self, cuts: list[str]) -> list[bytes]:
        found = list(map(self.cache.get, cuts))
        missing = [k for k, f in enumerate(found) if f is None]
        if missing:
            new = {cuts[k] for k in missing}
            if len(self.cache) + len(new) > KEPT:
                self.old, self.cache = self.cache, {c: f for c, f in zip(cuts, found, strict=True) if f is not None}
            self.cache.update({c: self.old[c] for c in new if c in self.old})
            self.encode_new([c for c in new if c not in self.old])
            for k in missing:
                found[k] = self.cache[cuts[k]]
        return found


class Pieces(pieces.Codec):
    """Pieces of a model; new cuts that begin with a space are encoded by the library, which puts that space before them."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        super().__init__(model)
        self.library = SentencePieceProcessor(model_proto=model)
        self.lengths = np.array([len(b) for b in self.bytes], "i8")

    def encode_new(self, cuts: list[str]) -> None:
        spaced = [c for c in cuts if c[0] == " " and c != " "]
        for c, ids in zip(spaced, self.library.encode([c[1:] for c in spaced], num_threads=1), strict=True):
            self.cache[c] = array("I", ids).tobytes()
        for c in cuts:
            if c not in self.cache:
                self.cache[c] = array("I", self.encode_cut(c)).tobytes()


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> np.ndarray:
    """For each multiple of ``work`` up to the whole, how many of the ends ``a`` are among the first so many of both,
    in ascending order with those of ``a`` first among equals."""
    at = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(at - len(b), 0), np.minimum(at, len(a))
    while (open := low < high).any():
        middle = (low + high) // 2
        first = np.zeros(len(at), bool)
        first[open] = a[middle[open]] <= b[at[open] - 1 - middle[open]]
        low, high = np.where(open & first, middle + 1, low), np.where(open & ~first, middle, high)
    return np.stack([low, at - low], 1)


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, close) of one piece: for each end, the number of ends of ``a`` and of ``b`` before it, which are the numbers of
    the tokens that overlap up to it, and whether both end there. Equal ends give one overlap."""
    both = np.concatenate([a, b])
    order = np.argsort(both, kind="stable")
    of_a = order < len(a)
    both = both[order]
    x = np.cumsum(of_a) - of_a
    y = np.arange(len(both)) - x
    twin = np.append(both[1:] == both[:-1], False)  # an end of a with the same of b right after it
    once = np.append(True, ~twin[:-1]) if len(both) else np.zeros(0, bool)
    return x[once], y[once], twin[once]


def overlaps(a: np.ndarray, b: np.ndarray, work: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, close) piece by piece: token x of ``a`` and y of ``b`` overlap, and ``close`` where they end together. An end of
    ``a`` whose equal in ``b`` lies beyond the diagonal goes with the next piece."""
    path = diagonals(a, b, work or WORK)
    begin = path[0]
    for end in path[1:]:
        i, j = end
        if i > begin[0] and j < len(b) and a[i - 1] == b[j]:
            i -= 1
        x, y, close = merged(a[begin[0] : i], b[begin[1] : j])
        yield x + begin[0], y + begin[1], close
        begin = (i, j)


def closes(a: np.ndarray, b: np.ndarray, work: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of tokens that end together, in order. They end the groups, which go on across pieces."""
    found = [(x[close], y[close]) for x, y, close in overlaps(a, b, work)]
    return tuple(np.concatenate([f[k] for f in found] or [np.zeros(0, "i8")]) for k in (0, 1))


@lru_cache(1)
def codecs(file: str, model: bytes) -> tuple[ByteLevel, Pieces]:
    """One pair per worker process."""
    return ByteLevel(file), Pieces(model)


@lru_cache(1)
def labels(size_a: int, size_b: int) -> list[str]:
    """The decimal ids with the sign after them: of a with a comma, with a bar, of b with a comma, with a semicolon."""
    return [f"{i}{sign}" for size, signs in ((size_a, ",|"), (size_b, ",;")) for sign in signs for i in range(size)]


def described(ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, size_a: int, size_b: int) -> str:
    """`a1,a2|b1;a3|b2,b3` of the groups that end with these tokens."""
    group_a, group_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    code_a, code_b = ids_a.astype("i8"), ids_b.astype("i8") + 2 * size_a
    code_a[last_a] += size_a
    code_b[last_b] += size_b
    out = np.empty(len(ids_a) + len(ids_b), "i8")
    out[np.arange(len(ids_a)) + np.repeat(last_b + 1 - group_b, group_a)] = code_a
    out[np.arange(len(ids_b)) + np.repeat(last_a + 1, group_b)] = code_b
    return "".join(map(labels(size_a, size_b).__getitem__, out.tolist()))[:-1]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of ROWS rows and about CHARACTERS characters at most, unless one text is longer."""
    ids, texts, held = [], [], 0
    for x in bpe.sliced(batches):
        for i, t in zip(x.column(0), x.column(1).to_pylist(), strict=True):
            if texts and (len(texts) >= ROWS or held + len(t or "") > CHARACTERS):
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(t or "")
            held += len(t or "")
    if texts:
        yield ids, texts


_ENCODED = "block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, own binary, times binary, pairs binary, totals binary"


def encoded(docs: DataFrame, id: str, text: str, path_a: str, path_b: str) -> DataFrame:
    """A row for each document, and one for each block (with pairs, a << 32 | b as 64-bit integers, and their totals).
    ``own`` are the places of the document's pairs among its block's, as 32-bit integers, ``times`` how many links each has."""
    file, model = Path(path_a).read_text(), pieces.read_model(path_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = codecs(file, model)
        number = TaskContext.get().partitionId() << 32
        for ids, texts in blocks(batches):
            rows, keys, count = [], [], []
            encoded_a, encoded_b = a.encode([" " + t if t else "" for t in texts]), b.encode(texts)
            ids_a, ids_b = (np.frombuffer(b"".join(e), "u4") for e in (encoded_a, encoded_b))
            size_a, size_b = a.size[ids_a], b.lengths[ids_b]
            at_a = at_b = 0
            for t, x, y in zip(texts, encoded_a, encoded_b, strict=True):
                n_a, n_b = len(x) // 4, len(y) // 4
                mine_a, mine_b = slice(at_a, at_a + n_a), slice(at_b, at_b + n_b)
                at_a, at_b = mine_a.stop, mine_b.stop
                whole = b"" if not t else (" " + t).encode()
                joined = a.decode(x) == whole == b"".join(map(b.bytes.__getitem__, ids_b[mine_b].tolist()))
                if not t or not joined:
                    rows.append((0, 0, 0, ""))
                    count.append(0)
                    continue
                last_a, last_b = closes(np.cumsum(size_a[mine_a]), np.cumsum(size_b[mine_b]))
                text_of = described(ids_a[mine_a], ids_b[mine_b], last_a, last_b, len(a.size), len(b.bytes))
                rows.append((n_a, n_b, len(last_a), hashlib.sha256(text_of.encode()).hexdigest()))
                keys.append(ids_a[mine_a][last_a].astype("i8") << 32 | ids_b[mine_b][last_b])
                count.append(len(last_a))
            links = np.concatenate([*keys, np.zeros(0, "i8")])
            pairs, place, totals = np.unique(links, return_inverse=True, return_counts=True)
            own, times, at = [], [], 0
            for n in count:
                some, often = np.unique(place[at : at + n], return_counts=True)
                own.append(some.astype("i4").tobytes())
                times.append(often.astype("i4").tobytes())
                at += n
            block = pa.array([number] * len(ids), pa.int64())
            n_groups = pa.array([r[2] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([i.as_py() for i in ids], ids[0].type), block, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), n_groups, n_groups,
                 pa.array([r[3] for r in rows]), pa.array(own, pa.binary()), pa.array(times, pa.binary()), pa.nulls(len(ids), pa.binary()), pa.nulls(len(ids), pa.binary())],
                names,
            )
            if len(pairs):
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, ids[0].type), pa.array([number], pa.int64()), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()), *[pa.nulls(1, pa.binary())] * 2,
                     pa.array([pairs.astype("<i8").tobytes()], pa.binary()), pa.array([totals.astype("<i8").tobytes()], pa.binary())],
                    names,
                )
            number += 1

    kind = docs.schema[id].dataType.simpleString()
    names = ["doc_id", *[c.split()[0] for c in _ENCODED.split(", ")]]
    return docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, {_ENCODED}")


def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (block, place, a, b, n) for each pair of a block."""
    for x in batches:
        for block, pairs, totals in zip(*(x.column(k).to_pylist() for k in range(3)), strict=True):
            keys, n = np.frombuffer(pairs, "<i8"), np.frombuffer(totals, "<i8")
            columns = [np.full(len(keys), block), np.arange(len(keys), dtype="i4"), (keys >> 32).astype("i4"), (keys & 0xFFFFFFFF).astype("i4"), n]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["block", "place", "a", "b", "n"])


def scored(documents: pa.Table, pairs: pa.Table) -> pa.Table:
    """n_best and count_sum of a block's documents, from the counts of its pairs."""
    count, best = np.zeros(pairs.num_rows, "i8"), np.zeros(pairs.num_rows, bool)
    place = pairs["place"].to_numpy()
    count[place], best[place] = pairs["count"].to_numpy(), pairs["best"].to_numpy()
    n_best, total = [], []
    for own, times in zip(documents["own"].to_pylist(), documents["times"].to_pylist(), strict=True):
        own, times = np.frombuffer(own, "i4"), np.frombuffer(times, "i4").astype("i8")
        n_best.append(int(times[best[own]].sum()))
        total.append(int((times * count[own]).sum()))
    kept = documents.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64())).append_column("groups_sha256", documents["groups_sha256"])


def align(docs: DataFrame, id: str = "doc_id", text: str = "text", path_a: str = DEFAULT_A, path_b: str = DEFAULT_B) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document.

    A is a byte-level BPE tokenizer, which gets a space before the text, B a SentencePiece model, which puts one there.
    A link is a pair of tokens that end together, so each group has one; its count is the number of links of its
    id pair in all documents. n_best counts the links whose pair is the most frequent of its B id, ties included.

    Null and empty texts, and texts whose tokens don't join to the space and the text, have no tokens: zeros, and ''
    for groups_sha256. Rows keep their id, null or repeated, one row for each; other columns aren't read; an empty
    table gives no rows. A text of any length is aligned whole, by one task.
    """
    rows = written(encoded(docs, id, text, path_a, path_b), "encoded")
    pairs = rows.where("pairs IS NOT NULL").select("block", "pairs", "totals").mapInArrow(spread, "block long, place int, a int, b int, n long")
    counts = written(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))  # a row for each id of B's vocabulary at most
    counts = counts.join(F.broadcast(most), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    counted = pairs.select("block", "place", "a", "b").join(counts, ["a", "b"]).select("block", "place", "count", "best")
    documents = rows.where("pairs IS NULL").drop("pairs", "totals")
    kind = docs.schema[id].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return documents.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(scored, schema)
