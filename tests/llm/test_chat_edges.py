"""op9 on an empty table and on very long turns."""

from chirpflow.llm import chat_format


def test_empty_table_and_long_turns(spark):
    long = "lo ng\n" * 300_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", "a"), (2, 0, "user", long), (3, 0, "user", long + "!")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert chat_format.format_chats(table.where("false")).collect() == []
    got = {r["conv_id"]: r for r in chat_format.format_chats(table).collect()}
    assert set(got) == {1, 3} and got[1]["n_turns"] == 2
    assert long in got[1]["rendered"] and long + "!" in got[3]["rendered"]
