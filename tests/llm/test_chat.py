import hashlib
import random

import pytest

from emberlog.llm import chat
from helpers import LONG

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, id string, alone int"
BITS = ["</s>", "[INST]", "[/INST]", "\\", "\\\\", "<|im_end|>\n", "<|im_start|>", "é", "𝄞", "\n", "a b", "<", "<<SYS>>", "|>", "", "<<s>", "[", "user"]


def rows(seed=4, n=150):
    r, out = random.Random(seed), []
    for c in range(n):
        for t in range(r.randrange(1, 7)):
            role = r.choice(["user", "assistant", "system", "us\ner", "a\\", "<|im_end|>", None, ""])
            out.append((c, r.choice([t, t, None, 1]), role, r.choice([None, "".join(r.choice(BITS) for _ in range(r.randrange(12)))]), "f", "i", 0))
    return out


def plain(rows):
    by = {}
    for c, t, role, text, *_ in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        loss = "".join(x for *_, r, x in sorted(turns) if r == "assistant")
        every = "".join(f"{r}\n{x}\n" for *_, r, x in sorted(turns))
        out[c] = (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("piece", [1 << 23, 60])
def test_round_trip(spark, monkeypatch, piece):
    monkeypatch.setattr(chat, "PIECE", piece)
    data = rows() + [(900, 0, "assistant", LONG, None, None, None), (900, 0, "assistant", LONG, None, None, None)]
    formatted = chat.format_chat(spark.createDataFrame(data, SCHEMA))
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digest(formatted).collect()}
    assert got == plain(data)
    for r in formatted.collect():
        turns = chat.read_chat(r.formatted)
        assert len(turns) == r.n_turns
        assert [chat.unescape(r.formatted[s.start:s.end].encode()).decode() for s in r.loss] == [x for role, x in turns if role == "assistant"]
        marks = r.formatted.encode()
        for control in chat.CONTROLS:  # only the template's own marks are left
            own = (chat.HEAD + chat.FOOT).count(control) * r.n_turns
            assert marks.count(control) == own


def test_rows_without_a_conversation_stand_alone(spark):
    data = [(None, 0, "user", "x", None, None, None)] * 3 + [(1, 0, "user", "y", None, None, None)]
    got = chat.format_chat(spark.createDataFrame(data, SCHEMA)).collect()
    assert sorted((r.conv_id or 0, r.n_turns) for r in got) == [(0, 1), (0, 1), (0, 1), (1, 1)]


def test_empty_table(spark):
    assert chat.digest(chat.format_chat(spark.createDataFrame([], SCHEMA))).count() == 0
