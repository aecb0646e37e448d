"""Byte-level BPE over Arrow batches with the tokenizers library.

The library works on characters, so each of the 256 bytes stands for a printable character. Merges follow
from the rank file: every split of a token into two tokens is a merge of the token's rank. Decoding looks
the characters up in the reversed table and joins bytes, so characters split between tokens come back
whole. Texts are cut where white space follows other text, which no match of the pattern crosses, and each
distinct cut of a stretch of rows is encoded once.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

DEFAULT_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

#: Distinct pieces kept by a worker in each of two generations, characters of a stretch, rows handled at a time.
KEPT, STRETCH, ROWS = 100_000, 1 << 20, 512
_ASCII_SPACE = tuple(" \t\n\r\x0b\x0c")

#: A piece: leading ASCII white space and what follows up to the next.
_PIECE = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: White space beyond ASCII: such a text is one piece, since a match may reach from it into a space.
_WIDE = re.compile("[%s]" % "".join(map(chr, [0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])))


def byte_characters() -> list[str]:
    """The character of each byte: printable Latin-1 ones stand for themselves, the others follow from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(path: str = DEFAULT_RANKS) -> bytes:
    """The rank file, read on the driver; tasks get its bytes (about 1 MB, whatever the data)."""
    return Path(path).read_bytes()


def ranks_of(ranks: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}


class Tables:
    """Bytes of each id, from the characters of its token by the reversed byte table. Decoding needs no more."""

    def __init__(self, vocabulary: dict[str, int]):
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        unknown = "\ufffd".encode()  # for ids that the file doesn't have
        tokens = [unknown] * (max(vocabulary.values()) + 2)
        for text, i in vocabulary.items():
            tokens[i] = bytes(byte_of[c] for c in text)
        self.size = np.fromiter(map(len, tokens), "i8", len(tokens))
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), "u1")

    def known(self, ids: bytes) -> np.ndarray:
        return np.minimum(np.frombuffer(ids, "<u4"), len(self.size) - 1)

    def decode(self, ids: bytes) -> bytes:
        parts, ids = [], self.known(ids)
        for k in range(0, len(ids), 1 << 18):
            some = ids[k : k + (1 << 18)]
            size = self.size[some]
            begin = np.cumsum(size) - size
            parts.append(self.bytes[np.repeat(self.start[some] - begin, size) + np.arange(size.sum())].tobytes())
        return b"".join(parts)

    def spans(self, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) of each token in characters; a token with part of a character spans it whole."""
        size = self.size[self.known(ids)]
        end = np.cumsum(size)
        place = np.cumsum((np.frombuffer(self.decode(ids), "u1") & 0xC0) != 0x80) - 1  # the character of each byte
        return place[end - size], place[end - 1] + 1


class Codec(Tables):
    """Tables with the library's tokenizer."""

    def __init__(self, ranks: bytes):
        by_bytes = ranks_of(ranks)
        table = byte_characters()
        as_text = lambda token: "".join(table[b] for b in token)
        vocabulary = {as_text(t): i for t, i in by_bytes.items()}
        super().__init__(vocabulary)
        merges = []
        for token in sorted(by_bytes, key=by_bytes.get):
            merges += [(as_text(token[:k]), as_text(token[k:])) for k in range(1, len(token)) if token[:k] in by_bytes and token[k:] in by_bytes]
        self.tokenizer = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def pieces(self, texts: list[str]) -> tuple[list[str], list[int]]:
        """The pieces of all texts, and how many each text has."""
        out, count = [], []
        for t in texts:
            new = [t] if _WIDE.search(t) else _PIECE.findall(t)
            out += new
            count.append(len(new))
        return out, count

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers. Two generations of pieces are kept, so
        that frequent ones outlive the many that come once."""
        wanted = set(pieces)
        if len(self.cache) + len(wanted) > KEPT:
            self.old, self.cache = self.cache, {}
        new = wanted.difference(self.cache)
        self.cache.update({p: self.old[p] for p in new if p in self.old})
        self.encode_new([p for p in new if p not in self.old])
        return list(map(self.cache.__getitem__, pieces))

    def encode_new(self, pieces: list[str]) -> None:
        """Pieces that begin with white space and end with something else are encoded as one text, since no
        match crosses from one into the next; the lengths of the tokens part their ids again."""
        together = [p for p in pieces if p[:1] in _ASCII_SPACE and not p[-1:].isspace()]
        alone = [p for p in pieces if not (p[:1] in _ASCII_SPACE and not p[-1:].isspace())]
        for k in range(0, len(alone), 4096):
            some = alone[k : k + 4096]
            for piece, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.cache[piece] = array("I", found.ids).tobytes()
        for k in range(0, len(together), 8192):
            some = together[k : k + 8192]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum([len(p.encode()) for p in some])
            cut = (np.searchsorted(np.cumsum(self.size[ids]), ends) + 1).tolist()
            at, flat = 0, ids.tobytes()
            for piece, end in zip(some, cut, strict=True):
                self.cache[piece] = flat[4 * at : 4 * end]
                at = end

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        some, held = [], 0
        for t in [*texts, None]:
            if some and (t is None or held + len(t) > STRETCH):
                pieces, count = self.pieces(some)
                found, at = self.encode_pieces(pieces), 0
                for n in count:
                    out.append(b"".join(found[at : at + n]))
                    at += n
                some, held = [], 0
            if t is not None:
                some.append(t)
                held += len(t)
        return out


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ROWS rows at most, so that what is made of them stays small."""
    for x in batches:
        for k in range(0, x.num_rows, ROWS):
            yield x.slice(k, ROWS)


@lru_cache(1)
def codec(ranks: bytes) -> Codec:
    """One per worker process."""
    return Codec(ranks)


@lru_cache(1)
def tables(ranks: bytes) -> Tables:
    """One per worker process that only decodes."""
    table = byte_characters()
    return Tables({"".join(table[b] for b in t): i for t, i in ranks_of(ranks).items()})


def encode(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str = DEFAULT_RANKS, offsets: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids): the whole text's ids as little-endian unsigned 32-bit integers, without special
    tokens; strings of special tokens are ordinary text. ``offsets`` adds begin and end, arrays with each
    token's characters.

    Null text counts as empty: no ids. Rows keep their id, null or repeated, one row for each; only the id
    and text columns are read; an empty table gives no rows.
    """
    ranks = read_ranks(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for x in sliced(batches):
            ids = own.encode([t or "" for t in x.column(1).to_pylist()])
            columns = [x.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
            names = ["doc_id", "n_tokens", "ids"]
            if offsets:
                spans = [own.spans(i) for i in ids]
                columns += [pa.array([s[k].astype("i4") for s in spans], pa.list_(pa.int32())) for k in (0, 1)]
                names += ["begin", "end"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids binary" + ", begin array<int>, end array<int>" * offsets
    return docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str = DEFAULT_RANKS, name: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids in the column ``name``, which it must not have yet. Bytes of a
    character split between tokens come together; ids outside the vocabulary give U+FFFD; null ids give null."""
    if name in encoded.columns:
        raise ValueError(f"there is a column {name} already: choose another name")
    ranks = read_ranks(path)
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tables(ranks)
        for x in sliced(batches):
            found = [None if i is None else own.decode(i) for i in x.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(found, pa.binary())], [*x.schema.names, name])

    return encoded.mapInArrow(run, encoded.withColumn(name, F.lit(b"")).schema)
