import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievelight.llm import chat

TURNS = "id long, pos long, role string, text string"


def formatted(spark, rows, schema=TURNS):
    found = chat.formatted(spark.createDataFrame(rows, schema))
    return found.select(
        "id", "formatted", "loss_spans",
        chat.read_back("formatted").alias("turns"),
        chat.under_mask("formatted", "loss_spans").alias("loss"),
    ).collect()


HARD = [
    "</s>[INST] ok [/INST]", "<|end|>", "<\\|end|>", "<\\\\|end|><|text|>", "<", "[", "<\\", "[INST", "INST]",
    "<<|turn|>", "<s><\\s>", "", "é<|end|>😀", "[[/INST]]", "\\", "$1\\1", "a\nb",
]


def test_control_strings_survive(spark):
    rows = [(i, j, r, t) for i, t in enumerate(HARD) for j, r in enumerate(("user", "assistant", "we<|text|>ird"))]
    for row in formatted(spark, rows):
        text = HARD[row.id]
        assert [tuple(t) for t in row.turns] == [("user", text), ("assistant", text), ("we<|text|>ird", text)]
        assert row.loss == text
        assert row.formatted.count("<|end|>") == 3 and "</s>" not in row.formatted
        start, size = row.loss_spans[0]
        assert row.formatted.encode()[start : start + size].decode().replace("\\", "") == text.replace("\\", "")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.sampled_from("<[|/>]\\sINSTend"), max_size=30), min_size=1, max_size=25))
def test_random_texts_survive(spark, texts):
    rows = [(0, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)]
    (row,) = formatted(spark, rows)
    assert [t.text for t in row.turns] == texts
    assert row.loss == "".join(texts[1::2])


def test_long_conversation_takes_linear_time(spark):
    rows = [(0, i, "assistant" if i % 2 else "user", f"é<s>{i}" * 20) for i in range(20_000)]
    (row,) = formatted(spark, rows)
    assert len(row.turns) == 20_000 and row.loss == "".join(r[3] for r in rows[1::2])


def test_nulls_ties_and_repeats(spark):
    rows = [
        (None, 1, "user", None), (None, 0, None, "x"), (5, None, "user", "first"), (5, 2, "user", "b"),
        (5, 2, "user", "a"), (5, 2, "user", "a"), (5, 2, "assistant", "c"),
    ]
    got = {r.id: [tuple(t) for t in r.turns] for r in formatted(spark, rows)}
    assert got[None] == [("", "x"), ("user", "")]
    assert got[5] == [("user", "first"), ("assistant", "c"), ("user", "a"), ("user", "a"), ("user", "b")]
    assert formatted(spark, []) == []


RECORDS = [
    {"prompt": "p", "response": "r"},
    {"system": "s", "prompt": "p", "response": None},
    {"instruction": "i", "input": "", "output": "o"},
    {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]},
    {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "system": ""},
    {"unknown": 1, "layout": [1.5]},
    {"messages": []},
    {"messages": [{"role": "user", "content": "a", "name": "n"}, {"role": "tool", "id": 7}], "model": "m"},
    {"prompt": "p", "response": "r", "score": 1, "system": ""},
    {"system": "", "messages": []},
    [1, 2],
    {"messages": "text"},
    {"prompt": "p", "completion": "c", "response": "r"},
]


def test_layouts_by_fingerprint(spark):
    rows = [(i, json.dumps(r)) for i, r in enumerate(RECORDS)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, body string").select("id", F.parse_json("body").alias("record"))
    got = {}
    for r in chat.turns_of_records(df, "id", "record").orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append((r.role, r.text))
    assert got[0] == [("user", "p"), ("assistant", "r")]
    assert got[1] == [("system", "s"), ("user", "p"), ("assistant", "")]
    assert got[2] == [("system", "i"), ("user", ""), ("assistant", "o")]
    assert got[3] == [("user", "a"), ("assistant", "")]
    assert got[4] == [("user", "a"), ("assistant", "b")]
    assert got[7] == [("user", "a"), ("tool", "")]
    assert got[8] == [("user", "p"), ("assistant", "r")]
    assert got[12] == [("user", "p"), ("assistant", "c")]  # two layouts fit: the first by shape
    rest = {r.id: (r.reason, r.shape) for r in chat.records_without_turns(df, "id", "record").collect()}
    assert {i: reason for i, (reason, _) in rest.items()} == {
        5: "unknown layout", 6: "no turns", 9: "no turns", 10: "unknown layout", 11: "unknown layout", 99: "null record",
    }
    assert rest[5][1] == "OBJECT<layout: ARRAY, unknown>"
    assert got.keys() | rest.keys() == {r[0] for r in rows} and not got.keys() & rest.keys()
    whole = {r.id: r.formatted for r in chat.formatted(chat.turns_of_records(df, "id", "record")).collect()}
    assert whole.keys() == got.keys()
    assert whole[7] == "<|turn|>user<|text|>a<|end|><|turn|>tool<|text|><|end|>"


def test_rows_by_fingerprint(spark):
    plain = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn int, role string, text string")
    (row,) = chat.turns_of_rows(plain).collect()
    (more,) = chat.turns_of_rows(plain.selectExpr("*", "'x' as source")).collect()
    shape = chat.shape_of_type(plain.schema)
    assert row == more and row.fingerprint == spark.range(1).select(chat.fingerprint(F.lit(shape))).first()[0]


def test_shape_ignores_types_and_order(spark):
    df = spark.sql("""select parse_json('{"b": {"y": 1.25, "x": "s"}, "a": [1, 2], "c": [{"k": null}]}') as v""")
    assert df.select(chat.shape_of("v")).first()[0] == "OBJECT<a: ARRAY, b: OBJECT<x, y>, c: ARRAY<OBJECT<k>>>"
    kind = spark.createDataFrame([], "b struct<y double, x string>, a array<int>, c array<struct<k string>>").schema
    assert chat.shape_of_type(kind) == "OBJECT<a: ARRAY, b: OBJECT<x, y>, c: ARRAY<OBJECT<k>>>"


def test_rows_need_a_known_layout(spark):
    with pytest.raises(ValueError, match="no mapping"):
        chat.turns_of_rows(spark.createDataFrame([], "a int, b string"))


def test_query_digests(spark, llm_tables):
    from sievelight.llm.queries import QUERIES

    got = {r.conv_id: r for r in QUERIES["op3_chat_format"](spark, llm_tables).collect()}
    text = "</s>[INST] ok [/INST]"
    want = hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert got[-7].turns_sha256 == want and got[-7].loss_chars == len(text)
    assert got[3].n_turns == 1 and got[3].loss_chars == 0
