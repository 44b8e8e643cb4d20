import hashlib

from pyspark.sql import functions as F

from clademill.llm import chat


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_roles_of_rows_stay_as_they_are(spark):
    rows = [(1, 0, "human", "a"), (1, 1, "gpt", "b"), (1, 2, "assistant", "c"), (2, None, None, None), (2, 5, "model", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit("own")).withColumn("turns", F.lit("own"))
    got = {r["conv_id"]: r for r in chat.digests(chat.chat_format(chat.records_of(turns))).collect()}
    assert got[1]["turns_sha256"] == sha("human\na\ngpt\nb\nassistant\nc\n") and got[1]["loss_sha256"] == sha("c")
    assert (got[2]["n_turns"], got[2]["turns_sha256"], got[2]["loss_chars"]) == (2, sha("\n\nmodel\n\n"), 0)


def test_layouts_side_by_side(spark):
    """Aliases are replaced where the layout has them; what can't be formatted keeps its row."""
    records = [
        (1, '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}'), (2, '{"prompt": "q", "completion": "r"}'),
        (3, '{"messages": [{"role": "human", "content": "q"}]}'), (4, '{"instruction": "i", "input": "", "output": "r"}'), (5, "[]"), (6, None),
    ]
    done = chat.chat_format(spark.createDataFrame(records, "conv_id long, record string"))
    turns = {r["conv_id"]: r["turns"] and [tuple(t) for t in r["turns"]] for r in done.collect()}
    pair = [("user", "q"), ("assistant", "r")]
    assert turns == {1: pair, 2: pair, 3: [("human", "q")], 4: [("user", "i"), ("assistant", "r")], 5: None, 6: None}
    got = {r["conv_id"]: r["n_turns"] for r in chat.digests(done).collect()}
    assert got == {1: 2, 2: 2, 3: 1, 4: 2, 5: None, 6: None}
