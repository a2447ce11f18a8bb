from ledgerloom.llm import chat

from .helpers import duck, same_rows, small

SCHEMA = "conv_id long, turn long, role string, text string"


def test_small_table_in_sql(spark):
    same_rows(chat.rotate(small(spark, "conversations")), duck().execute(chat.ORACLE))


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 3)  # offsets over several blocks
    turns = [(1, i, ("system", "ann", "bob", "cy")[i % 4], f"line {i} é") for i in range(20)] + [(2, 0, "user", "hi"), (2, 1, "assistant", "ho")]
    got = chat.rotate(spark.createDataFrame(turns, SCHEMA))
    whole = {(r["conv_id"], r["perspective"]): r for r in chat.dialogues(got).collect()}
    assert set(whole) == {(1, "ann"), (1, "bob"), (1, "cy"), (2, "user"), (2, "assistant")}
    for (conv, who), d in whole.items():
        said = [t for c, _, role, t in turns if c == conv and role == who]
        assert [d["text"][s["start"] : s["end"]] for s in d["loss"]] == [f"{t}<|im_end|>" for t in said]
    assert "user name=ann" in whole[1, "bob"]["text"] and "system\nline 0" in whole[1, "bob"]["text"]
    for r in got.collect():
        assert whole[r["conv_id"], r["perspective"]]["text"][r["start"] : r["end"]] == r["segment"]
        assert (r["loss_start"] is not None) == (r["speaker"] == r["perspective"])


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, None, "a", "x"), (1, 0, "a", ""), (2, 0, "system", "only"), (None, 0, "u", "n"), (None, 1, "v", "y" * 300_000)]
    got = chat.rotate(spark.createDataFrame([(*r, 5) for r in rows], SCHEMA + ", start int")).collect()
    assert {(r["conv_id"], r["perspective"]) for r in got} == {(1, "unknown"), (1, "a"), (None, "u"), (None, "v")}
    first = sorted((r["start"], r["end"], r["seq"]) for r in got if r["conv_id"] == 1 and r["perspective"] == "a")
    assert len(first) == 4 and all(a[1] == b[0] for a, b in zip(first, first[1:], strict=False)) and first[0][0] == 0
    assert chat.rotate(spark.createDataFrame([], SCHEMA)).count() == 0
