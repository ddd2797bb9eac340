"""op6 against its SQL on odd conversations: control strings, backslashes, ties, nulls, long turns, late system turns."""

import random

import duckdb

from scorelake.llm import chat


def test_odd_conversations_match_sql(spark, tmp_path):
    rng = random.Random(3)
    bits = ["word ", "\\", "\n", "<|turn|>", "<|", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "été 漢字 ", "a.b!", "\x0b\x1f ", "<", "["]
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 14)):
            role = rng.choice(["user", "assistant", "system", None, "tool\n<|x", "assistant"]) if turn or conv % 2 else "system"
            text = None if rng.random() < 0.05 else "".join(rng.choices(bits, k=rng.choice([0, 3, 60, 400, 1500])))
            rows.append((conv, rng.choice([turn, turn, 1]), role, text))
    rows += rows[:5] + [(None, 0, "user", "hi"), (None, 1, "assistant", "ho")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got, want = chat.op6_chat_format(spark, str(tmp_path)), con.sql(chat.OP6_SQL)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
