"""Round trips of formatted conversations, and layouts by fingerprint."""

import hashlib
import json
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siteloom.llm import chat_format as C
from siteloom.llm import queries

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(turns):
    by = {}
    for conv, turn, role, text in turns:
        by.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0], r[1].encode(), r[2].encode()))
        loss = "".join(t for _, r, t in rows if r == "assistant")
        out[conv] = (len(rows), sha("".join(f"{r}\n{t}\n" for _, r, t in rows)), len(loss), sha(loss))
    return out


def read_back(turns):
    out = C.formatted(turns).withColumn("turns", C.read_turns(F.col("formatted"))).withColumn(
        "loss", C.read_loss(F.col("formatted"), F.col("loss_spans")))
    return {r["conv_id"]: (len(r["turns"]), sha("".join(f"{t['role']}\n{t['text']}\n" for t in r["turns"])),
                           len(r["loss"]), sha(r["loss"]), r["formatted"]) for r in out.collect()}


def test_query_on_given_tables(spark):
    turns = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist()]
    turns += [(-1, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))]
    rows = queries.QUERIES["op1_chat_format"](spark, SF).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in rows} == expected(turns)
    assert next(r["formatted_chars"] for r in rows if r["conv_id"] == -1) == len(
        "<s>user\n<\\/s>[\\INST] ok [\\/INST]</s><s>assistant\n<\\/s>[\\INST] ok [\\/INST]</s>")


def test_hostile_texts_come_back(spark):
    rng = random.Random(5)
    parts = ["<s>", "</s>", "<\\s>", "<\\\\/s>", "[INST]", "[/INST]", "[\\INST]", "\\", "\n", "<", "[", "/s>", "é", "日", "$1", " ", "𝄞"]
    turns = [(i % 40, rng.randrange(4), rng.choice(["user", "assistant", "tool\n<s>", "sys tem+%", None, "</s>"]),
              "".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for i in range(600)]
    turns += [(100, None, None, None), (None, 1, "assistant", "x"), (None, 1, "assistant", "x"), (101, 0, "assistant", "")]
    turns += [(102, 0, "assistant", "long </s> " * 20000)]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    got = read_back(C.canonical_turns(df))
    assert {k: v[:4] for k, v in got.items()} == expected(turns)
    for n, (count, *_, text) in zip([v[0] for v in got.values()], got.values(), strict=True):
        assert text.count(C.BEGIN) == text.count(C.END) == n == count and "[INST]" not in text


RECORDS = [
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q", "name": "x"}]}, "messages",
     [("system", "s"), ("user", "q")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}], "id": 3}, "from and value",
     [("user", "q"), ("assistant", "")]),
    ({"instruction": "do", "input": "", "output": "done", "prompt": 1}, "instruction with input", [("user", "do"), ("assistant", "done")]),
    ({"instruction": "do", "input": "this", "output": "done"}, "instruction with input", [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"prompt": "p", "completion": "c"}, "prompt and completion", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": None}, "prompt and response", [("user", "p")]),
    ({"question": "p", "answer": "c", "text": "more"}, "question and answer", [("user", "p"), ("assistant", "c")]),
]


def test_json_records_of_mixed_layouts(spark):
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)] + [(90, "{no json"), (91, None), (92, '{"a": 1}')]
    turns, rest = C.canonical_json_turns(spark.createDataFrame(rows, "conv_id long, record string"), "record")
    got = {}
    for r in sorted(turns.collect(), key=lambda r: (r["conv_id"], r["turn"])):
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got == {i: t for i, (_, _, t) in enumerate(RECORDS)}
    assert sorted(r["conv_id"] for r in rest.collect()) == [90, 91, 92]


REJECTED = [
    ({"instruction": "", "output": ""}, "no turns"), ({"prompt": None, "completion": None}, "no turns"),
    ({"messages": [{"role": "user", "content": "q"}, "plain"]}, "an element is no message"),
    ({"messages": [{"role": "user", "content": "q"}, {"other": 1}]}, "an element is no message"),
    ({"messages": []}, "no layout"), ({"messages": [None]}, "no layout"), ({"messages": "text"}, "no layout"),
    ({"messages": ["plain"]}, "no layout"), ([1, 2], "no layout"), ("text", "no layout"), (None, "no layout"), ({}, "no layout"),
]


def test_json_records_are_kept_or_rejected_whole(spark):
    kept = [(1, {"turn": 2, "role": "user", "text": "again"}), (1, {"turn": 0, "role": "user", "text": "question"}),
            (1, {"turn": 1, "role": "assistant", "text": "reply"}), (1, {"turn": None, "role": None, "text": None}),
            (2, {"messages": [None, {"content": "no role"}, {"role": "user", "content": ["a", 1]}, {"role": "gpt"}]}),
            (None, {"prompt": "p", "completion": "c"}), (None, {"prompt": "p", "completion": "c"}),
            (3, {"conversations": [{"value": "x"}, {"from": "human", "value": None}], "turn": 7}),
            (4, {"turn": "none", "role": "tool", "text": 5})]
    rows = [(i, json.dumps(r), "clash", "clash") for i, r in kept] + [(100 + i, json.dumps(r), "", "") for i, (r, _) in enumerate(REJECTED)]
    turns, rest = C.canonical_json_turns(spark.createDataFrame(rows, "conv_id long, record string, layout string, parsed string"), "record")
    got = {}
    for r in turns.collect():
        got.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    in_order = lambda t: ((t[0] is not None, t[0] or 0), *t[1:])
    assert {k: [t[1:] for t in sorted(v, key=in_order)] for k, v in got.items()} == {
        1: [("", ""), ("user", "question"), ("assistant", "reply"), ("user", "again")],
        2: [("", "no role"), ("user", '["a",1]'), ("assistant", "")],
        None: [("user", "p"), ("user", "p"), ("assistant", "c"), ("assistant", "c")],
        3: [("", "x"), ("user", "")], 4: [("tool", "5")]}
    assert {r["conv_id"]: r["reason"] for r in rest.collect()} == {100 + i: reason for i, (_, reason) in enumerate(REJECTED)}
    text = next(r["formatted"] for r in C.formatted(turns).filter("conv_id = 1").collect())
    assert text == "<s>\n</s><s>user\nquestion</s><s>assistant\nreply</s><s>user\nagain</s>"
    assert all(d.count() == 0 for d in C.canonical_json_turns(spark.createDataFrame([], "conv_id long, record string"), "record"))


def test_conversations_as_json_records(spark):
    given = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist()]
    rows = queries.QUERIES["chat_records"](spark, SF).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in rows} == expected(given)
    made = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "do\n\nthis"), (2, 1, "assistant", "a"), (3, 0, "user", ""),
            (3, 1, "assistant", "a"), (4, None, None, None), (5, 3, "system", "s"), (5, 3, "system", "s"), (None, 1, "user", "x")]
    records = queries.json_records(spark.createDataFrame(made, "conv_id long, turn long, role string, text string"))
    turns, rest = C.canonical_json_turns(records, "record")
    assert rest.count() == 0 and {k: v[:4] for k, v in read_back(turns).items()} == expected(made)
    every = queries.json_records(spark.read.parquet("/root/testdata/sf0.1/conversations.parquet"))
    marked = every.select(F.try_parse_json("record").alias("parsed")).select(C.json_layout().alias("layout")).distinct()
    assert {"turn rows", "messages", "from and value", "instruction"} <= {r["layout"] for r in marked.collect()}


@pytest.mark.parametrize("number", [i for i, (r, _, _) in enumerate(RECORDS) if None not in r.values()])
def test_typed_tables_by_schema(spark, number):
    record, name, turns = RECORDS[number]
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(record | {"conv_id": 1})]))
    assert C.layout_of(df.schema).name == name
    assert [(r["role"], r["text"]) for r in C.canonical_turns(df).orderBy("turn").collect()] == turns


def test_unknown_layout_and_empty_table(spark):
    with pytest.raises(ValueError):
        C.layout_of(spark.range(1).schema)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.formatted(C.canonical_turns(empty)).count() == 0


def test_plan_is_native(spark):
    plan = queries.QUERIES["op1_chat_format"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
