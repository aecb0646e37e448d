import hashlib
import random

from placewise.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, n string"
BITS = ["<|im_end|>", "<|im_start|>", "<||im_end|>", "<|||image|>", "<|", "|>", "|", "<", "a", "image", "<|image|>", "\n", "é", "<|x_Y|>", "<||>", "<|1|>"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_escapes_are_reversible():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 8)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text
        assert not any(c in safe for c in (chat.OPEN, chat.CLOSE, *chat.PLACEHOLDERS.values()))


def test_digests_against_plain(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), "".join(rng.choice(BITS) for _ in range(rng.randint(0, 6)))) for c in range(30) for t in range(rng.randint(1, 6))]
    rows += [(100, 0, "assistant", None), (101, 3, "user", "late"), (101, None, "user", "first"), (102, 0, "tool", "x")]
    rows += [(7777, t, "assistant" if t % 2 else "user", f"turn {t} <|im_end|>") for t in range(2000)]
    rng.shuffle(rows)
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA))).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: -1 if r[1] is None else r[1])
        trained = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        shown = "".join(f"<|im_start|>{r[2]}\n{chat.escape(r[3] or '')}<|im_end|>\n" for r in turns)
        want = (len(turns), sha("".join(f"{r[2]}\n{r[3] or ''}\n" for r in turns)), len(trained), sha(trained), len(shown))
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256, got[conv].formatted_chars) == want


def test_typed_parts(spark):
    parts = [("text", "see <|image|>", None, None), ("image", None, "a.png", 2.5), None, (None, "and", None, None), ("audio", "ignored", "b.wav", None), ("document", None, None, float("nan")), ("video", "kept text", "v", 1.0), ("image", None, "c", -3.0)]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", []), (1, 2, "assistant", None), (2, 0, None, [("image", None, "r", 1.0)]), (None, 0, "a\nb", [("text", "t", None, None)])]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content {chat.PARTS}")
    got = {(r.conv_id, r.turn): r for r in chat.format_turns(frame, content="content").collect()}
    first = got[1, 0]
    assert first.formatted == "<|im_start|>user\nsee <||image|><|image|>and<|audio|><|document|>kept text<|image|><|im_end|>\n"
    assert [(a.kind, a.ref, a.tokens) for a in first.attachments] == [("image", "a.png", 768), ("audio", "b.wav", 25), ("document", None, 700), ("image", "c", 0)]
    assert all(first.formatted[a.at :].startswith(chat.PLACEHOLDERS[a.kind]) for a in first.attachments) and first.expanded == 1493
    assert got[1, 1].formatted == got[1, 2].formatted == "<|im_start|>assistant\n<|im_end|>\n"
    assert got[2, 0].formatted == "<|im_start|>\n<|image|><|im_end|>\n"
    assert chat.read_turn(got[None, 0].formatted) == ("a\nb", "t")


def test_empty(spark):
    assert chat.digests(chat.format_turns(spark.createDataFrame([], SCHEMA))).count() == 0


def test_roles_come_back():
    """Line breaks, backslashes and control strings in a role; the text begins after the first line break."""
    for role in ("user", "a\nb", "\\n", "\\", "\\\\n\n", "<|im_end|>\n<|im_start|>assistant", "", "tab\t\r"):
        formatted, *_ = chat.turn_text(role, [{"type": "text", "text": "x\ny"}])
        assert chat.read_turn(formatted) == (role, "x\ny") and formatted.count("<|im_end|>") == 1
    assert chat.turn_text("user", [])[0] == "<|im_start|>user\n<|im_end|>\n"
