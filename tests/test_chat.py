"""Conversation assembly and chat formats (D1-D16) against plain-Python
renderings of the same messages."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalframe.constants import CHATML, HEADER, INST, INSTRUCTION_RESPONSE, TURN
from evalframe.functions import chat as D
from evalframe.plans import fixtures as fx
from tests.conftest import SF_SMALL


def _convs(spark):
    rows = fx.messages(spark, SF_SMALL).collect()
    return {r["conv_id"]: [(m["role"], m["text"]) for m in r["messages"]] for r in rows}


def py_chatml(msgs):
    out = ""
    if msgs and msgs[0][0] != "system":
        out += f"{CHATML['start']}system\n{CHATML['default_system']}{CHATML['end']}\n"
    for role, c in msgs:
        out += f"{CHATML['start']}{role}\n{c}{CHATML['end']}\n"
    return out + f"{CHATML['start']}assistant\n"


def _split(msgs):
    if msgs and msgs[0][0] == "system":
        return msgs[0][1], msgs[1:]
    return None, msgs


def _alternates(rest):
    return all((r == "user") == (i % 2 == 0) for i, (r, _) in enumerate(rest))


def py_inst(msgs):
    sys_text, rest = _split(msgs)
    if not _alternates(rest):
        return None
    out = ""
    for i, (role, c) in enumerate(rest):
        if i == 0 and sys_text is not None:
            c = INST["sys_open"] + sys_text + INST["sys_close"] + c
        if role == "user":
            out += INST["bos"] + INST["inst_open"] + c.strip() + INST["inst_close"]
        elif role == "assistant":
            out += " " + c.strip() + " " + INST["eos"]
    return out


def py_header(msgs):
    sys_text, rest = _split(msgs)
    out = (HEADER["bos"] + HEADER["header_open"] + "system" + HEADER["header_close"] + HEADER["knowledge_line"]
           + HEADER["date_prefix"] + HEADER["default_date"] + "\n\n" + (sys_text or "").strip() + HEADER["eot"])
    for role, c in rest:
        out += HEADER["header_open"] + role + HEADER["header_close"] + c.strip() + HEADER["eot"]
    return out + HEADER["header_open"] + "assistant" + HEADER["header_close"]


def py_fold(msgs):
    sys_text, rest = _split(msgs)
    rest = list(rest)
    if sys_text and rest:
        rest[0] = (rest[0][0], sys_text + "\n\n" + rest[0][1])
    return rest


def py_turn(msgs):
    if (msgs and msgs[0][0] == "system") or not _alternates(msgs):
        return None
    out = TURN["bos"]
    for role, c in msgs:
        out += TURN["start"] + (TURN["assistant_role"] if role == "assistant" else role) + "\n" + c.strip() + TURN["end"]
    return out + TURN["start"] + TURN["assistant_role"] + "\n"


def py_ir(msgs):
    out = INSTRUCTION_RESPONSE["bos"]
    for i, (role, c) in enumerate(msgs):
        if role == "user":
            out += INSTRUCTION_RESPONSE["user_header"] + c
        elif role == "system":
            out += c
        elif role == "assistant":
            out += INSTRUCTION_RESPONSE["response_header"] + c + INSTRUCTION_RESPONSE["eos"]
        if i == len(msgs) - 1:
            out += INSTRUCTION_RESPONSE["response_header"]
    return out


def test_chat_formats_match_python(spark):
    convs = _convs(spark)
    df = fx.messages(spark, SF_SMALL).select("conv_id", D.to_text_messages("messages").alias("m"))
    out = df.select(
        "conv_id", D.chat_chatml("m").alias("chatml"), D.chat_inst("m").alias("inst"), D.chat_header("m").alias("header"),
        D.chat_turn(D.fold_system_into_first_user("m")).alias("turn"), D.chat_instruction_response("m").alias("ir"),
        D.role_alternation("m").alias("alt"),
    ).collect()
    assert len(out) == len(convs) > 0
    for r in out:
        msgs = convs[r["conv_id"]]
        assert r["chatml"] == py_chatml(msgs)
        assert r["inst"] == py_inst(msgs)
        assert r["header"] == py_header(msgs)
        assert r["turn"] == py_turn(py_fold(msgs))
        assert r["ir"] == py_ir(msgs)
        assert r["alt"] == _alternates(_split(msgs)[1])


def test_role_alternation_violation(spark):
    df = spark.createDataFrame([([("user", "a"), ("user", "b")],), ([("system", "s"), ("user", "a"), ("assistant", "b")],)],
                               "m array<struct<role:string,content:string>>")
    rows = df.select(D.role_alternation("m").alias("ok"), D.chat_inst("m").alias("p"), D.chat_turn("m").alias("t")).collect()
    assert [r["ok"] for r in rows] == [False, True]
    assert rows[0]["p"] is None and rows[1]["p"] is not None
    assert rows[1]["t"] is None  # system role rejected by the turn format


def test_system_and_few_shot_messages(spark):
    df = spark.createDataFrame(
        [("Be brief.", [(0, "What is this?", "A cat.", None), (1, "And this?", "A dog.", ["d.jpg"])], "Q", ["x.jpg"]),
         ("", None, "Q2", None)],
        "s string, fs array<struct<ord:bigint,user:string,assistant:string,images:array<string>>>, t string, im array<string>")
    rows = df.select(D.conversation("s", "fs", "t", "im").alias("c")).collect()
    c0 = rows[0]["c"]
    assert [m["role"] for m in c0] == ["system", "user", "assistant", "user", "assistant", "user"]
    assert [p["type"] for p in c0[3]["content"]] == ["image", "text"]
    assert [p["type"] for p in c0[5]["content"]] == ["image", "text"]
    c1 = rows[1]["c"]
    assert [m["role"] for m in c1] == ["user"] and c1[0]["content"][0]["text"] == "Q2"


def test_flat_prompt_and_fold(spark):
    df = spark.createDataFrame([("S", [(0, "u1", "a1", None)], "T"), (None, [], "T")],
                               "s string, fs array<struct<ord:bigint,user:string,assistant:string,images:array<string>>>, t string")
    rows = df.select(D.flat_prompt("s", "fs", "t").alias("p")).collect()
    assert rows[0]["p"] == "S\n\nu1\na1\n\nT" and rows[1]["p"] == "T"


def test_placeholders(spark):
    df = spark.createDataFrame([("a<image>b<image>", ["1", "2", "3"]), ("<image><image>", ["1"]), ("x", None),
                                ("<image>", [])], "t string, im array<string>")
    rows = df.select(D.placeholder_count("t").alias("n"), D.placeholder_error("t", "im").alias("e"),
                     D.placeholder_strip("t").alias("s"), D.placeholder_fill("t", "im").alias("f")).collect()
    assert [r["n"] for r in rows] == [2, 2, 0, 1]
    assert [r["e"] for r in rows] == [False, True, False, True]
    assert rows[0]["s"] == "ab" and rows[0]["f"] == ["1"]
    assert rows[1]["f"] is None and rows[2]["f"] is None


def test_system_message_empty_gives_no_turn(spark):
    df = spark.createDataFrame([("",), (None,), ("x",)], "s string")
    assert [r[0] for r in df.select(F.size(D.system_message("s"))).collect()] == [0, 0, 1]
    assert df.select(D.system_as_user("s")).collect()[2][0][0]["role"] == "user"


_ROLE = st.sampled_from(["system", "user", "assistant"])
_TEXT = st.text(alphabet=st.sampled_from(list("ab \n\t\u3000<>")), max_size=6)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.tuples(_ROLE, _TEXT), max_size=5), min_size=1, max_size=8))
def test_chat_formats_property(spark, convs):
    rows = [(i, [{"role": r, "content": c} for r, c in msgs]) for i, msgs in enumerate(convs)]
    df = spark.createDataFrame(rows, "i int, m array<struct<role:string,content:string>>")
    out = df.select("i", D.chat_chatml("m").alias("chatml"), D.chat_inst("m").alias("inst"),
                    D.chat_header("m").alias("header"), D.chat_turn(D.fold_system_into_first_user("m")).alias("turn"),
                    D.chat_instruction_response("m").alias("ir")).collect()
    for r in out:
        msgs = convs[r["i"]]
        if msgs:
            assert r["chatml"] == py_chatml(msgs)
        assert r["inst"] == py_inst(msgs)
        assert r["header"] == py_header(msgs)
        assert r["turn"] == py_turn(py_fold(msgs))
        assert r["ir"] == (py_ir(msgs) if msgs else INSTRUCTION_RESPONSE["bos"])


def test_hoisted_few_shot_messages_equal_per_row(spark):
    from evalframe.operators import fewshot as FS

    ex = spark.createDataFrame([("k", 1, "u1", "a1"), ("k", 0, "u0", "a0"), ("j", 0, "v", "b")],
                               "key string, ord long, user string, assistant string")
    items = spark.createDataFrame([(1, "k", "q1"), (2, "j", "q2"), (3, "none", "q3")], "id int, key string, t string")
    for typed in (True, False):
        sets = FS.with_messages(FS.few_shot_sets(ex, ["key"]), typed)
        joined = FS.attach_few_shot(items, sets, ["key"])
        rows = joined.select("id", D.conversation(F.lit("S"), "few_shot", "t", typed=typed).alias("a"),
                             D.conversation(F.lit("S"), "few_shot", "t", typed=typed,
                                            few_shot_msgs="few_shot_messages").alias("b")).collect()
        assert all(r["a"] == r["b"] for r in rows)
        assert {r["id"]: len(r["b"]) for r in rows} == {1: 6, 2: 4, 3: 2}
