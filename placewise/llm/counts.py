"""Edit-aware token counts.

A document's text is kept as leaves of whole pre-tokens with their characters and token counts, under a tree
of sums (a segment tree laid out as a heap). An edit is found by walking down the character sums. Only the
leaves it touches are encoded again, with as many neighbours as the boundary needs: leaves meet where white
space follows something else, which no pre-token crosses, and if an edit takes that away the region
grows by a leaf. Then the sums above the changed leaves are updated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.llm.bpe import DEFAULT_RANKS, Codec, codec, read_ranks, sliced

#: Characters of a leaf, about.
LEAF = 128
EDITS = "array<struct<begin:int,end:int,text:string>>"

#: A place where two leaves can meet: before white space, after something else.
_SEAM = re.compile(r"(?<=\S)(?=[ \t-\r])")


def leaves(text: str) -> list[str]:
    """The text in stretches of about LEAF characters that meet at seams; without a seam in reach a stretch is longer."""
    out, begin = [], 0
    while len(text) - begin > LEAF:
        seam = _SEAM.search(text, begin + LEAF)
        if seam is None:
            break
        out.append(text[begin : seam.start()])
        begin = seam.start()
    return [*out, text[begin:]]


class Tree:
    """Sums over leaves: node k has children 2k and 2k + 1, leaf i is node width + i."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.width = 1 << max(0, len(chars) - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), "i8")
        self.sums[self.width : self.width + len(chars)] = np.c_[chars, tokens]
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    def find(self, place: int) -> tuple[int, int]:
        """(leaf, characters before it) of a character; the end of the text is in the last leaf that has any."""
        place = min(place, max(0, int(self.sums[1, 0]) - 1))
        k, before = 1, 0
        while k < self.width:
            k *= 2
            if place - before >= self.sums[k, 0]:
                before += int(self.sums[k, 0])
                k += 1
        return k - self.width, before

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        k = leaf + self.width
        step = np.array([chars, tokens]) - self.sums[k]
        while k:
            self.sums[k] += step
            k //= 2


def counted(own: Codec, texts: list[str]) -> list[int]:
    return [len(x) // 4 for x in own.encode(texts)]


class Document:
    """A text as leaves under a tree."""

    def __init__(self, own: Codec, text: str, tokens: list[int] | None = None):
        self.own, self.leaves = own, leaves(text)
        tokens = counted(own, self.leaves) if tokens is None else tokens
        self.tree = Tree(np.array(list(map(len, self.leaves))), np.array(tokens))
        self.encoded = 0  # characters encoded again by edits

    @property
    def tokens(self) -> int:
        return int(self.tree.sums[1, 1])

    def edit(self, begin: int, end: int, text: str) -> None:
        """Replace the characters from begin to end (in the text as it is now)."""
        size = int(self.tree.sums[1, 0])
        begin = min(max(begin, 0), size)
        end = min(max(end, begin), size)
        first, before = self.tree.find(begin)
        last, _ = self.tree.find(max(begin, end - 1))
        body = "".join(self.leaves[first : last + 1])
        body = body[: begin - before] + text + body[end - before :]
        while first > 0 and not self._seam(self.leaves[first - 1][-1:], body[:1]):
            first -= 1
            body = self.leaves[first] + body
        while last + 1 < len(self.leaves) and not self._seam(body[-1:], self.leaves[last + 1][:1]):
            last += 1
            body += self.leaves[last]
        for i in range(first, last + 1):
            self.leaves[i] = body if i == first else ""
            self.tree.put(i, len(self.leaves[i]), counted(self.own, [body])[0] if i == first else 0)
        self.encoded += len(body)

    @staticmethod
    def _seam(left: str, right: str) -> bool:
        return bool(left and right and _SEAM.search(left + right))


def index(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str = DEFAULT_RANKS) -> DataFrame:
    """(doc_id, text, n_tokens, leaf_tokens): the counts that edits start from, one array element per leaf (the
    leaves follow from the text). Null text counts as empty, with no tokens. Rows keep their id."""
    ranks = read_ranks(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for x in sliced(batches):
            texts = [t or "" for t in x.column(1).to_pylist()]
            cut = [leaves(t) for t in texts]
            flat = counted(own, [leaf for c in cut for leaf in c])
            tokens, at = [], 0
            for c in cut:
                tokens.append(flat[at : at + len(c)])
                at += len(c)
            yield pa.RecordBatch.from_arrays(
                [x.column(0), pa.array(texts, pa.string()), pa.array(map(sum, tokens), pa.int64()), pa.array(tokens, pa.list_(pa.int32()))], ["doc_id", "text", "n_tokens", "leaf_tokens"]
            )

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id].dataType.simpleString()}, text string, n_tokens long, leaf_tokens array<int>")


def recount(indexed: DataFrame, path: str = DEFAULT_RANKS) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_after, chars_after, chars_encoded): counts of :func:`index` with a
    further column edits (EDITS) after those edits, in the order of their begin.

    Edits name characters of the indexed text and don't overlap; one that begins before the end of the one
    before it is left out, as are null ones; n_edits counts those made. begin and end outside the text are moved
    to its ends, null text inserts nothing. chars_encoded is what was encoded again.
    """
    ranks = read_ranks(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for x in sliced(batches):
            found = []
            for text, tokens, edits in zip(*(x.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                doc, made, shift, done = Document(own, text, tokens), 0, 0, 0
                size = len(text)
                for e in sorted((e for e in edits or [] if e and e["begin"] is not None and e["end"] is not None), key=lambda e: (e["begin"], e["end"], e["text"] or "")):
                    begin = min(max(e["begin"], 0), size)
                    end = min(max(e["end"], begin), size)
                    if begin < done:
                        continue
                    new = e["text"] or ""
                    doc.edit(begin + shift, end + shift, new)
                    shift += len(new) - (end - begin)
                    done, made = end, made + 1
                found.append((made, doc.tokens, int(doc.tree.sums[1, 0]), doc.encoded))
            columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), *columns], ["doc_id", "n_tokens", "n_edits", "n_tokens_after", "chars_after", "chars_encoded"])

    kind = indexed.schema["doc_id"].dataType.simpleString()
    rows = indexed.select("doc_id", "n_tokens", "text", "leaf_tokens", F.col("edits").cast(EDITS))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_edits long, n_tokens_after long, chars_after long, chars_encoded long")


def gathered(edits: DataFrame) -> DataFrame:
    """(doc_id, edits) of an edit log (doc_id, begin, end, text). Of edits with the same begin the smallest
    stays, so a document has at most one per character, however often the log repeats them."""
    first = edits.groupBy("doc_id", "begin").agg(F.min(F.struct("end", "text")).alias("e"))
    return first.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "e.end", "e.text")).alias("edits"))
