"""Chat formatting with typed content parts.

A visitor flattens the parts of each turn in order: text as it is, with control strings escaped, an image,
audio or document part as one placeholder. Each placeholder is recorded with its reference and the number
of tokens it expands to. Turns are formatted on their own, wherever they lie; what concerns a whole
conversation is read from its turns in order, as a stream.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Every control string begins and ends like this; inside texts the bar is doubled as often as it takes.
_CONTROL = re.compile(r"<(\|+)(?=[A-Za-z_]+\|>)")
_ESCAPED = re.compile(r"<\|(\|+)(?=[A-Za-z_]+\|>)")
_ATTACHED = re.compile("|".join(map(re.escape, PLACEHOLDERS.values())))
#: Tokens of one attachment unit: image tiles, audio seconds, document pages.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 700}
TRAINED = ("assistant",)

PARTS = "array<struct<type:string,text:string,ref:string,units:double>>"


def escape(text: str) -> str:
    """Text without control strings: one bar more after each '<' that a control string could follow.
    Strings that look escaped already get one bar more too, so ``unescape`` gives the text back."""
    return _CONTROL.sub(r"<|\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1", text)


def escape_role(role: str) -> str:
    """A role without line breaks, which end it: a break as backslash and n, a backslash as two."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass
class Flattened:
    """Collects what a turn's parts give."""

    body: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    length: int = 0

    def add(self, text: str) -> None:
        self.body.append(text)
        self.length += len(text)

    def visit(self, part: dict | None) -> None:
        kind = (part or {}).get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_other)(part or {})

    def visit_text(self, part: dict) -> None:
        self.add(escape(part.get("text") or ""))

    def visit_attachment(self, part: dict) -> None:
        kind = part["type"]
        units = part.get("units")
        units = max(0, math.ceil(units)) if units is not None and math.isfinite(units) else 1
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "at": self.length, "tokens": units * UNIT_TOKENS[kind]})
        self.add(PLACEHOLDERS[kind])

    visit_image = visit_audio = visit_document = visit_attachment

    def visit_other(self, part: dict) -> None:
        """An unknown type counts as text: what text it has is kept."""
        self.visit_text(part)


def turn_text(role: str | None, parts: list[dict | None]) -> tuple[str, int, int, list[dict]]:
    """(formatted turn, first and end character under the loss mask, attachments with their place in the turn).
    Nothing of a turn whose role isn't trained on is under the mask."""
    role = role or ""
    head = f"{OPEN}{escape_role(role)}\n"
    flat = Flattened()
    for p in parts:
        flat.visit(p)
    body = "".join(flat.body)
    begin, end = (len(head), len(head) + len(body)) if role in TRAINED else (0, 0)
    return f"{head}{body}{CLOSE}\n", begin, end, [a | {"at": a["at"] + len(head)} for a in flat.attachments]


def read_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn. A formatted role holds no line break."""
    role, _, body = formatted[len(OPEN) :].partition("\n")
    return unescape_role(role), unescape(body[: -len(CLOSE) - 1])


TURNS = "conv_id long, turn long, formatted string, loss_begin int, loss_end int, attachments array<struct<kind:string,ref:string,at:int,tokens:long>>, expanded long"


def format_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """One row per turn: (conv_id, turn, formatted, loss_begin, loss_end, attachments, expanded).

    ``content`` is a string or an array of typed parts (PARTS). formatted is the turn between its marks;
    loss_begin to loss_end are its characters under the loss mask (none: 0, 0); attachments hold each
    placeholder's kind, reference, character and tokens after expansion; expanded sums those tokens.
    Null contents, parts and texts count as empty, a null role as the empty one, missing or non-finite units as
    one; line breaks in a role are escaped like control strings. Nulls in conv_id and turn stay. Other columns are not read.
    """
    text = content if rows.schema[content].dataType.typeName() == "array" else None
    parts = F.col(content).cast(PARTS) if text else F.array(F.struct(F.lit("text").alias("type"), F.col(content).cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            found = [turn_text(r, p or []) for r, p in zip(x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    x.column(0),
                    x.column(1),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.int32()),
                    pa.array([f[2] for f in found], pa.int32()),
                    pa.array([f[3] for f in found], pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("tokens", pa.int64())]))),
                    pa.array([sum(a["tokens"] for a in f[3]) for f in found], pa.int64()),
                ],
                ["conv_id", "turn", "formatted", "loss_begin", "loss_end", "attachments", "expanded"],
            )

    return rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string"), parts.alias("parts")).mapInArrow(run, TURNS)


def digests(turns: DataFrame) -> DataFrame:
    """One row per conversation, read back from formatted turns: (conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars). turns_sha256 covers role, line break, text, line break of each turn;
    loss_sha256 the unescaped text under the mask, nothing between; formatted_chars the whole conversation.

    Turns are taken by number (null first), equal numbers by their formatted text. A task streams through
    its conversations, so one of any length is never held in memory; rows with a null conv_id are one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []

        def close() -> None:
            if state:
                done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def out() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array([d[k] for d in done], t) for k, t in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for x in batches:
            for conv, formatted, begin, end in zip(*(x.column(k).to_pylist() for k in range(4)), strict=True):
                if state is None or conv != key:
                    close()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_turn(formatted)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                trained = unescape(formatted[begin:end])
                state[2] += len(trained)
                state[3].update(trained.encode())
                state[4] += len(formatted)
            yield out()
            done.clear()
        close()
        yield out()

    rows = turns.select("conv_id", "turn", "formatted", "loss_begin", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.select("conv_id", "formatted", "loss_begin", "loss_end").mapInArrow(run, schema)
