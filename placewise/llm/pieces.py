"""SentencePiece encoding of merge-type models by backtracking, and decoding.

A merge-type model joins the best-scored pair of neighbours again and again, the leftmost of equals. Its result
is the one sequence of pieces whose neighbours all fit: two pieces fit if merging their joined characters
from the start gives the two again. So the encoder takes the longest match at each place (Aho-Corasick), a shorter one
where the neighbours don't fit, and goes a piece back where none does; a bit marks each place that was left
that way, so that no place is tried twice. Texts are cut before runs of spaces and around line feeds where no piece
of the model reaches across, and each distinct cut of a stretch of rows is encoded once.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from placewise.llm.bpe import sliced

DEFAULT_MODEL = public_tokenizers.path("piece_bpe_32k.model")

#: Distinct cuts kept by a worker in each of two generations, pairs of pieces kept, characters of a stretch.
KEPT, PAIRS, STRETCH = 250_000, 1_000_000, 1 << 20
SPACE = "▁"
_SIGNS = frozenset(c for c in map(chr, range(33, 127)) if not c.isalpha())


def read_model(path: str = DEFAULT_MODEL) -> bytes:
    """The model file, read on the driver; tasks get its bytes (about 0.5 MB, whatever the data)."""
    return Path(path).read_bytes()


class Vocabulary:
    """Pieces and scores of a model, with a space for U+2581, and decoding."""

    def __init__(self, model: bytes):
        library = SentencePieceProcessor(model_proto=model)
        if library.normalize("a  b\tÅﬁ ") != SPACE + "a  b\tÅﬁ ".replace(" ", SPACE):
            raise ValueError("only models that leave texts as they are but for a space before them")
        size = library.vocab_size()
        names = [library.id_to_piece(i) for i in range(size)]
        self.byte_ids, self.texts, self.scores = [0] * 256, {}, {}
        self.bytes: list[bytes] = [b""] * size
        self.single = bytearray(size)  # ids that stand for one byte each
        for i, name in enumerate(names):
            if library.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                self.bytes[i], self.single[i] = bytes([int(name[3:5], 16)]), 1
            elif library.is_unknown(i):
                self.bytes[i] = " ⁇ ".encode()
            elif not library.is_control(i) and not library.is_unused(i):
                text = name.replace(SPACE, " ")
                self.texts[text], self.scores[text] = i, library.get_score(i)
                self.bytes[i] = text.encode()
        self.nothing = {i for i in range(size) if not self.bytes[i]}
        self.end = library.eos_id()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; control ids give nothing, and the space before the text goes. Bytes that
        are no UTF-8 give U+FFFD each."""
        while ids and ids[-1] in self.nothing:
            ids = ids[:-1]
        first = next((i for i in ids if self.bytes[i]), None)
        if self.nothing.isdisjoint(ids):
            found = b"".join(map(self.bytes.__getitem__, ids)).decode(errors="each_byte")
        else:  # bytes on both sides of a control id don't make a character
            parts: list[list[bytes]] = [[]]
            for i in ids:
                parts.append([]) if i in self.nothing else parts[-1].append(self.bytes[i])
            found = "".join(b"".join(p).decode(errors="each_byte") for p in parts)
        return found[1:] if first is not None and not self.single[first] and found[:1] == " " else found


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


__import__("codecs").register_error("each_byte", _each_byte)


class Codec(Vocabulary):
    """A vocabulary with the encoder."""

    def __init__(self, model: bytes):
        super().__init__(model)
        self.name = {i: t for t, i in self.texts.items()}
        self.history: dict[int, list[tuple[float, str, str]]] = {}
        self.fits: dict[int, bool] = {}
        self.longest: list[str | None] = []
        # pieces that merging never makes are no candidates
        usable = [t for t, i in self.texts.items() if self.merged(t) is not None]
        self.automaton = ahocorasick.Automaton()
        for t in usable:
            self.automaton.add_word(t, self.texts[t])
        self.automaton.make_automaton()
        self.ids = {t: self.texts[t] for t in usable}
        self.most = max(map(len, usable))
        self.size, self.shorter = [0] * len(self.bytes), [-1] * len(self.bytes)  # -1: no shorter one
        for t in usable:
            self.size[self.texts[t]] = len(t)
            self.shorter[self.texts[t]] = next((self.ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ids), -1)
        self.plain = all(chr(c) in self.ids for c in range(32, 127))
        self.split = self.cutter()
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def cutter(self) -> re.Pattern:
        """What parts a text into cuts that no piece reaches across: runs of spaces, of ASCII signs and digits, and of
        other characters, in this order, and line feeds by themselves; coarser ones where the model has
        pieces that do."""
        after = {(x in _SIGNS, y in _SIGNS, x == " ", y) for t in self.texts for x, y in zip(t, t[1:])}
        if any(y == " " and not space for _, _, space, y in after):
            return re.compile("(?s).+")
        if any("\n" in t for t in self.texts):
            return re.compile("(?s) *[^ ]+| +")
        if any(sign and not (before or space) for before, sign, space, _ in after):
            return re.compile(" *[^ \n]+| +|\n")
        sign, other = "[!-@[-`{-~]", "[^ \n!-@[-`{-~]"
        return re.compile(f" *{sign}*{other}+| *{sign}+| +|\n")

    def merged(self, text: str) -> list[tuple[float, str, str]] | None:
        """The merges that make a piece of its characters, in order: score, first and last symbol afterwards.
        None if they end in several symbols."""
        symbols, steps = list(text), []
        while len(symbols) > 1:
            score, at = max(((self.scores.get(symbols[k] + symbols[k + 1]), -k) for k in range(len(symbols) - 1) if symbols[k] + symbols[k + 1] in self.scores), default=(None, 0))
            if score is None:
                return None
            symbols[-at : 2 - at] = [symbols[-at] + symbols[1 - at]]
            steps.append((score, symbols[0], symbols[-1]))
        return steps

    def steps(self, i: int) -> list[tuple[float, str, str]]:
        if i not in self.history:
            self.history[i] = self.merged(self.name[i])
        return self.history[i]

    def fit(self, a: int, b: int) -> bool:
        """Whether two neighbours stay apart: the merges inside both are replayed in their common order, and a pair
        across their border must never be the best; of equal scores the leftmost is."""
        key = a << 32 | b
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            found = self.fits[key] = self.replayed(a, b)
        return found

    def replayed(self, a: int, b: int) -> bool:
        left, right = self.steps(a), self.steps(b)
        last, first = self.name[a][-1], self.name[b][0]
        i = j = 0
        lowest = float("-inf")
        while True:
            across = self.scores.get(last + first)
            of_a = left[i][0] if i < len(left) else lowest
            of_b = right[j][0] if j < len(right) else lowest
            if across is not None and across > of_a and across >= of_b:
                return False
            if i < len(left) and of_a >= of_b:
                last = left[i][2]
                i += 1
            elif j < len(right):
                first = right[j][1]
                j += 1
            else:
                return True

    def match(self, text: str, begin: int) -> int:
        """The longest usable piece at a place."""
        text = text[begin : begin + self.most]
        size = self.automaton.longest_prefix(text)
        found = self.ids.get(text[:size])
        while found is None:
            size -= 1
            found = self.ids.get(text[:size])
        return found

    def backtrack(self, text: str, out: list[int], at: int, take: int) -> list[int]:
        """The pieces of a text of known characters. ``out`` are pieces up to the place ``at`` whose neighbours fit,
        ``take`` is the piece to try next."""
        size, shorter, known, match, stop = self.size, self.shorter, self.fits.get, self.match, len(text)
        failed = bytearray(stop // 8 + 1)
        last = out[-1] if out else -1
        while at < stop:
            while take >= 0:
                end = at + size[take]
                if not failed[end >> 3] >> (end & 7) & 1:
                    ok = last < 0 or known(last << 32 | take)
                    if ok or ok is None and self.fit(last, take):
                        break
                take = shorter[take]
            if take >= 0:
                out.append(take)
                last, at = take, end
                if end < stop:
                    take = match(text, end)
            else:  # nothing fits here: no sequence has a border here
                failed[at >> 3] |= 1 << (at & 7)
                at -= size[out.pop()]
                take = shorter[last]
                last = out[-1] if out else -1
        return out

    def known(self, text: str) -> list[int]:
        return self.backtrack(text, [], 0, self.match(text, 0))

    def encode_cut(self, text: str) -> list[int]:
        """Runs of known characters by backtracking, other characters byte by byte."""
        out: list[int] = []
        begin = 0
        for k, c in enumerate(text):
            if c not in self.texts:
                if begin < k:
                    out += self.known(text[begin:k])
                out += [self.byte_ids[x] for x in c.encode()]
                begin = k + 1
        return out + self.known(text[begin:]) if begin < len(text) else out

    def encode_new(self, cuts: list[str]) -> None:
        """The longest matches of all cuts in one pass of the automaton; where they cover a cut and all neighbours
        fit, they are its pieces. Others are encoded with steps back. A line feed parts the cuts, unless the model has
        pieces with it."""
        if "\n" in self.texts or len(cuts) < 2:
            for c in cuts:
                self.cache[c] = array("I", self.encode_cut(c)).tobytes()
            return
        size, known = self.size, self.fits.get
        matches = self.automaton.iter_long("\n".join(cuts) + "\n")
        end, piece = next(matches, (1 << 62, 0))
        begin = 0
        for c in cuts:
            stop, place, ids, last = begin + len(c), begin, [], -1
            while end < stop:
                if end + 1 - size[piece] != place:
                    break  # a character that no piece has
                if last >= 0:
                    ok = known(last << 32 | piece)
                    if not ok and (ok is not None or not self.fit(last, piece)):
                        break
                ids.append(piece)
                last, place = piece, end + 1
                end, piece = next(matches, (1 << 62, 0))
            if place < stop:
                if self.plain and c.isascii() and c.isprintable() or all(map(self.texts.__contains__, c)):
                    ids = self.backtrack(c, ids, place - begin, self.shorter[piece])
                else:
                    ids = self.encode_cut(c)
                while end < stop:
                    end, piece = next(matches, (1 << 62, 0))
            self.cache[c] = array("I", ids).tobytes()
            begin = stop + 1

    def encode_cuts(self, cuts: list[str]) -> list[bytes]:
        """Ids of each cut as unsigned 32-bit integers; two generations are kept, so that frequent cuts outlive
        the many that come once."""
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

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit integers, without control ids."""
        out: list[bytes] = []
        some: list[str] = []
        count: list[int] = []
        held = 0
        for t in [*texts, None]:
            if count and (t is None or held + len(t) > STRETCH):
                found, at = self.encode_cuts(some), 0
                for n in count:
                    out.append(b"".join(found[at : at + n]))
                    at += n
                some, count, held = [], [], 0
            if t is not None:
                cuts = self.split.findall(" " + t.replace(SPACE, " ")) if t else []
                some += cuts
                count.append(len(cuts))
                held += len(t)
        return out


@lru_cache(1)
def codec(model: bytes) -> Codec:
    """One per worker process."""
    return Codec(model)


@lru_cache(1)
def vocabulary(model: bytes) -> Vocabulary:
    """One per worker process that only decodes."""
    return Vocabulary(model)


def encode(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str = DEFAULT_MODEL, end: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids): the whole text's ids as the library gives them without sampling, with the end id
    as the last one if ``end``. Strings of control pieces inside texts are ordinary text.

    Null text counts as empty: no ids but the end. Rows keep their id, null or repeated, one row for each; only
    the id and text columns are read, whatever others are there; an empty table gives no rows. Texts of any length
    are encoded whole, a stretch without spaces too.
    """
    model = read_model(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        last = array("I", [own.end]).tobytes() if end else b""
        for x in sliced(batches):
            ids = [i + last for i in own.encode([t or "" for t in x.column(1).to_pylist()])]
            sizes = np.array([len(i) // 4 for i in ids], "i8")
            flat = np.frombuffer(b"".join(ids), "i4")
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("i4")
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(sizes), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "n_tokens", "ids"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str = DEFAULT_MODEL, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids in the column ``name``, which it must not have yet; null ids give null."""
    if name in encoded.columns:
        raise ValueError(f"there is a column {name} already: choose another name")
    model = read_model(path)
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model)
        for x in sliced(batches):
            column = x.column(at)
            flat, ends = column.values.to_numpy(), column.offsets.to_pylist()
            found = [own.decode(flat[b:e].tolist()) if v else None for b, e, v in zip(ends, ends[1:], column.is_valid().to_pylist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(found, pa.string())], [*x.schema.names, name])

    return encoded.mapInArrow(run, encoded.withColumn(name, F.lit("")).schema)
