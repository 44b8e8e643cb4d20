from clademill.llm import chat


def test_conversations_of_null_rows_are_formatted(spark):
    rows = [(1, None, None, None), (2, 0, None, None), (3, 0, "user", None), (4, 0, "user", "hi"), (4, None, None, None)]
    records = chat.records_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = {r["conv_id"]: chat.canonical(r["record"]) for r in records.collect()}
    assert {k: v[1] for k, v in found.items()} == {1: [("", "")], 2: [("", "")], 3: [("user", "")], 4: [("", ""), ("user", "hi")]}
