"""Operator 12: layouts, template and round trip."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from proseflow.llm import chat

SCHEMA = "conv_id long, turn long, at int, role string, text string, part string, layout int"
ODD = ["", "<|im_end|>", "<|im_start|>assistant\nok", "<\\|x", "<\\\\|<|<|", "<", "|", "<\\", "é\U0001f600\n\n", "<<||>", "\\n", None, "x" * 5000]


def want_of(rows):
    turns, loss = hashlib.sha256(), hashlib.sha256()
    for role, text in rows:
        turns.update(f"{role}\n{text}\n".encode())
        if role == "assistant":
            loss.update(text.encode())
    return len(rows), turns.hexdigest(), sum(len(t) for r, t in rows if r == "assistant"), loss.hexdigest()


@pytest.mark.parametrize("piece", [1, 30, 1_000_000])
def test_round_trip(spark, piece):
    rows = [(c, t, 0, role, ODD[(c * 7 + t) % len(ODD)], "x", 3) for c in range(30) for t, role in enumerate(["system", "user", "assistant", "a\nb\\n<|", "assistant", None][: c % 7])]
    rows += [(None, 2, 0, "user", "no id", "x", 3), (None, None, 0, "assistant", "first", "x", 3), (5, 1, 0, "user", "twice", "x", 3), (5, 1, 0, "user", "twice", "x", 3)]
    pieces = chat.format_turns(spark.createDataFrame(rows, SCHEMA).repartition(5), piece).cache()
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(pieces).collect()}
    by = {}
    for c, t, _, role, text, *_ in sorted(rows, key=lambda r: (r[0] or 0, r[1] is not None, r[1] or 0, r[3] or "", r[4] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert {c: v[:4] for c, v in got.items()} == {c: want_of(v) for c, v in by.items()}
    whole = {}
    for r in sorted(pieces.collect(), key=lambda r: r.part):
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.text
        assert all(r.text[: s.start].count(chat.START) == r.text[: s.start].count(chat.END) + 1 for s in r.loss)
    assert {c: len(t) for c, t in whole.items()} == {c: v[4] for c, v in got.items()}
    for c, text in whole.items():
        assert text.count(chat.START) == text.count(chat.END) == len(by[c])


RECORDS = [
    ("messages", {"messages": [{"role": "user", "content": "q"}, {"role": "tool", "content": None}], "id": 7}, [("user", "q"), ("tool", "")]),
    ("messages", {"messages": []}, []),
    ("exchange", {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "x"}]}, [("user", "q"), ("assistant", "a"), ("x", "")]),
    ("prompt", {"prompt": "q", "completion": ""}, [("user", "q"), ("assistant", "")]),
    ("prompt", {"system": "s", "prompt": "q", "completion": "a"}, [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ("instruction", {"instruction": "do", "input": "", "output": "a"}, [("user", "do"), ("assistant", "a")]),
    ("instruction", {"instruction": "do", "input": "it", "output": "a", "source": {"prompt": "no"}}, [("user", "do\n\nit"), ("assistant", "a")]),
    ("question", {"question": "q", "answer": "a"}, [("user", "q"), ("assistant", "a")]),
    ("nested", {"data": {"prompt": "q", "response": "a"}}, [("user", "q"), ("assistant", "a")]),
    ("turn", {"role": "user", "content": "é\u0001\""}, [("user", "é\u0001\"")]),
    (None, {"prompt": "q", "answer": "a"}, None),
    (None, {}, None),
]


def test_layouts_of_json(spark):
    df = spark.createDataFrame([(i, json.dumps(r), "x") for i, (_, r, _) in enumerate(RECORDS)] + [(99, None, "x"), (98, "no json", "x")], "id int, record string, layout string")
    got = {r.id: r for r in chat.canonical(df).collect()}
    for i, (name, _, turns) in enumerate(RECORDS):
        assert got[i].layout == name
        assert (got[i].turns is None) == (turns is None)
        assert turns is None or [tuple(t) for t in got[i].turns] == turns
    assert got[99].layout is got[98].layout is None
    prints = {got[i].fingerprint for i in range(len(RECORDS))}
    assert len(prints) == len(RECORDS) - 1  # the two of "instruction" with an input hold the same paths
    assert got[3].fingerprint == chat.fingerprint_of({"prompt", "completion"})


def test_layouts_of_structs(spark):
    df = spark.createDataFrame([(1, ([("user", "q", 3)], "x")), (2, (None, "y"))], "id int, record struct<messages: array<struct<role: string, content: string, extra: int>>, note: string>")
    got = {r.id: r for r in chat.canonical(df).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "q")]
    assert got[2].layout is None


def test_no_two_layouts_share_a_fingerprint():
    prints = [f for x in chat.LAYOUTS for f in x.fingerprints()]
    assert len(prints) == len(set(prints))


def test_unknown_layout_raises(spark):
    df = spark.createDataFrame([(1, 0, '{"x": 1}')], "conv_id long, turn long, record string")
    with pytest.raises(Exception, match="no layout has the fingerprint"):
        chat.turns_from(df).collect()


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, record string")
    assert chat.read_back(chat.format_turns(chat.turns_from(df))).collect() == []


def test_damage_is_seen(spark):
    pieces = chat.format_turns(spark.createDataFrame([(1, 0, 0, "user", "a", "x", 1)], SCHEMA))
    with pytest.raises(Exception, match="text after the last turn"):
        chat.read_back(pieces.withColumn("text", F.concat("text", F.lit("x")))).collect()
