"""Chat formatting against a plain formatter and exact round trips."""

import random

import pytest
from pyspark.sql import functions as F

from reelrank.llm import chat

ROWS = "conv_id long, turn long, role string, text string, segment string, loss_spans int"
NASTY = ["", " ", "\\", "\\s", "\\b\\", "### ", "###", "</turn>", "</turn>\n", "<</turn>/turn>", "</part>", ": ", "a: b\n", "</tur",
         "\\### Assistant: </turn> ok", "é🎈 漢字", "\u0000x", "\r\n\t"]


def _key(r):
    return (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")


def _plain(rows):
    """conv -> (turn strings, loss text, formatted length)."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=_key)]
        size, before = 0, None
        for role, text in turns:
            size += len(chat.PART) if role == before else len(chat.HEAD + _esc(role, chat.ROLE_CODES) + chat.SEP + chat.END) + 1
            size += len(_esc(text, chat.CODES))
            before = role
        out[conv] = ([f"{r}\n{t}\n" for r, t in turns], "".join(t for r, t in turns if r == "assistant"), size)
    return out


def _esc(s, codes):
    s = s.replace("\\", "\\b")
    for k, v in codes.items():
        s = s.replace(k, v)
    return s


def _check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS)
    seg = chat.format_conversations(df).cache()
    got = {r.conv_id: (list(r.turns), r.loss_text, len(r.formatted)) for r in chat.read_back(seg).collect()}
    assert got == _plain(rows)
    return seg.collect()


def test_round_trip_of_odd_rows(spark):
    rng = random.Random(3)
    rows = [(c, rng.choice([None, 0, 1, 2, 7, -3]), rng.choice(["user", "assistant", "system", "", None, "a: b", ":", "### x</turn>\n"]),
             rng.choice([None, "".join(rng.choices(NASTY, k=rng.randint(1, 4)))]))
            for c in [None, 1, 2, 3, 4, 5] for _ in range(rng.randint(1, 12))]
    segs = _check(spark, rows + rows[:5])  # repeated rows are turns of their own
    assert {s.n_segments for s in segs} == {1}


def test_long_conversation_is_cut_and_joins(spark):
    rng = random.Random(4)
    rows = [(9, t, rng.choice(["user", "assistant"]) if t not in range(60, 70) else "assistant", rng.choice(NASTY)) for t in range(300)]
    rows += [(None, t, "assistant", "x") for t in range(200)] + [(8, None, "user", f"{i}") for i in range(100)]
    rows += [(7, t, "user", "hi") for t in range(3)]
    segs = _check(spark, rows)
    assert {s.conv_id: s.n_segments for s in segs} == {9: 5, None: 4, 8: 1, 7: 1}
    nine = "".join(s.text for s in sorted((s for s in segs if s.conv_id is None), key=lambda s: s.segment))
    assert nine.count(chat.HEAD) == 1 and nine.count(chat.END) == 1


def test_spans_are_code_points_and_bytes(spark):
    df = spark.createDataFrame([(1, 0, "user", "é", "", 0), (1, 1, "assistant", "🎈b", "", 0), (1, 1, "assistant", "", "", 0)], ROWS)
    r = chat.format_conversations(df).first()
    assert r.text == "### user: é</turn>\n### assistant: </part>🎈b</turn>\n"
    spans = [r.text[s.start:s.start + s.length] for s in r.loss_spans]
    raw = [r.text.encode()[s.byte_start:s.byte_start + s.byte_length].decode() for s in r.loss_spans]
    assert spans == raw == ["", "🎈b"]


def test_very_long_text(spark):
    text = "### \\</turn>é" * 200_000
    got = chat.read_back(chat.format_conversations(spark.createDataFrame([(1, 0, "assistant", text, "", 0)], ROWS))).first()
    assert got.loss_text == text and got.turns == [f"assistant\n{text}\n"]


def test_empty_table(spark):
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], ROWS))).collect() == []


@pytest.mark.parametrize("text", NASTY)
def test_marks_never_occur_in_escaped_text(spark, text):
    row = spark.range(1).select(chat.escape(F.lit(text), chat.ROLE_CODES).alias("e")).select("e", chat.unescape(F.col("e")).alias("u")).first()
    assert row.u == text and not any(m in row.e for m in chat.ROLE_CODES)
