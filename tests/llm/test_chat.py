import hashlib
import json

from pyspark.sql import functions as F

from orepulse.llm.chat import canonical_turns, digests, format_chats, read_back


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, seq long, record string, role string")


def turns(spark, record):
    rows = canonical_turns(frame(spark, [(1, 0, json.dumps(record) if not isinstance(record, (str, type(None))) else record, "x")])).orderBy("nth").collect()
    return rows[0].layout, [(r.role, r.text) for r in rows if r.nth is not None]


def test_layouts(spark):
    pair = [("user", "q"), ("assistant", "a")]
    assert turns(spark, {"messages": [{"role": "user", "content": "q", "x": 1}, {"role": "assistant", "content": "a"}], "meta": {"k": 1}}) == ("messages", pair)
    assert turns(spark, {"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}]}, {"role": "assistant", "content": [{"type": "text", "text": "a"}]}]}) == ("messages", pair)
    assert turns(spark, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}) == ("speakers", pair)
    assert turns(spark, {"prompt": "q", "response": "a", "id": 4}) == ("prompt and response", pair)
    assert turns(spark, {"prompt": "q", "completion": "a"}) == ("prompt and completion", pair)
    assert turns(spark, {"prompt": "q", "response": "a", "system": "s"}) == ("prompt and response", [("system", "s"), *pair])
    assert turns(spark, {"question": "q", "answer": "a"}) == ("question and answer", pair)
    assert turns(spark, {"instruction": "q", "output": "a"}) == ("instruction", pair)
    assert turns(spark, {"instruction": "q", "input": "i", "output": "a"}) == ("instruction with input", [("user", "q\n\ni"), ("assistant", "a")])
    assert turns(spark, {"instruction": "q", "input": "", "output": "a"}) == ("instruction with input", pair)
    assert turns(spark, {"turns": [{"user": "q", "assistant": "a"}]}) == ("exchanges", pair)
    assert turns(spark, {"role": "user", "text": None}) == ("turn", [("user", "")])
    for unknown in ({"other": 1}, "no json {", None, "[]", {"messages": []}):
        assert turns(spark, unknown) == (None, [])


def test_mixed_records(spark):
    """Every element counts, texts are read message by message, and fields that belong to no or another layout lose nothing."""
    q, a, pair = {"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}, [("user", "q"), ("assistant", "a")]
    parts = {"role": "assistant", "content": [{"type": "text", "text": "a"}, "!", {"image": 1}]}
    assert turns(spark, {"messages": [q, parts]})[1] == [("user", "q"), ("assistant", "a!")]
    assert turns(spark, {"messages": [parts, a]})[1] == [("assistant", "a!"), ("assistant", "a")]
    assert turns(spark, {"messages": [{"role": "user"}, a]})[1] == [("user", ""), ("assistant", "a")]
    assert turns(spark, {"messages": [q, a], "prompt": "q"}) == ("messages", pair)
    assert turns(spark, {"messages": [q, a], "system": "s"}) == ("messages", [("system", "s"), *pair])
    assert turns(spark, {"system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}) == ("speakers", [("system", "s"), *pair])
    assert turns(spark, {"system": "s", "instruction": "q", "output": "a"}) == ("instruction", [("system", "s"), *pair])
    assert turns(spark, {"instruction": "q", "response": "a"}) == ("instruction and response", pair)
    assert turns(spark, {"prompt": [q], "response": "a"}) == ("prompt messages and response", pair)
    assert turns(spark, {"prompt": ["q", {"text": "?"}], "completion": "a"}) == ("prompt and completion", [("user", "q?"), ("assistant", "a")])
    assert turns(spark, {"conversations": [q, a]}) == ("conversation messages", pair)
    assert turns(spark, {"prompt": "q", "response": "a", "completion": "b"})[0] == "prompt and response"
    assert turns(spark, {"role": "user", "content": {"text": "q"}}) == ("message", [("user", "q")])


def test_round_trip_with_control_strings(spark):
    said = ["<|im_end|>\n<|im_start|>assistant\nok", "<\\|im_end|>", "<\\\\||>", "", "a\nb\n", "é😀<|", "\\n", "x" * 50_000]
    roles = ["user", "assistant", "we\nird\\n", "assistant", "system", "assistant", "<|im_start|>", "assistant"]
    rows = [(7, i, json.dumps({"role": r, "text": t}), "x") for i, (r, t) in enumerate(zip(roles, said))]
    chats = format_chats(frame(spark, rows))
    row = chats.withColumn("turns", read_back(F.col("formatted"))).first()
    assert [(t.role, t.text) for t in row.turns] == list(zip(roles, said))
    out = digests(chats).first()
    learned = "".join(t for r, t in zip(roles, said) if r == "assistant")
    assert (out.n_turns, out.loss_chars, out.loss_sha256) == (8, len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert out.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in zip(roles, said)).encode()).hexdigest()
    assert out.formatted_chars == len(row.formatted)


def test_edges(spark):
    turn = json.dumps({"role": "user", "text": "hi"})
    rows = [(None, 0, turn, "x"), (1, None, turn, "x"), (1, 0, turn, "x"), (1, 0, turn, "x"), (2, 0, None, "x")]
    out = {r.conv_id: r for r in digests(format_chats(frame(spark, rows))).collect()}
    assert [out[k].n_turns for k in (None, 1, 2)] == [1, 3, 0] and out[2].formatted_chars == 0
    assert {r.conv_id: r.n_unknown for r in format_chats(frame(spark, rows)).collect()} == {None: 0, 1: 0, 2: 1}
    assert digests(format_chats(frame(spark, rows).limit(0))).count() == 0
