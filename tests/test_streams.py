"""Conversations kept as stream state, and tables copied between stores."""

import random

import pytest
from pyspark.sql import functions as F
from tessera.operators import conversation
from tessera.sources.store import Store, content_id
from tessera.streaming import conversations


@pytest.mark.parametrize("limits", [{}, {"max_messages": 4, "message_chars": 50, "total_chars": 120}, {"max_messages": 3, "message_chars": 30, "total_chars": 31}])
def test_packs_of_a_stream_that_is_restarted(spark, tmp_path, limits):
    rng = random.Random(len(limits))
    rows = [(c, t, rng.choice(["system", "user", "user", "assistant"]), rng.choice(["", "x" * rng.randrange(90), "é" * rng.randrange(40), None]), f"s{c}" if t == 0 else f"late{t}" if t == 2 else None) for c in range(12) for t in range(rng.randrange(1, 14))]
    rng.shuffle(rows)
    for part in range(4):  # four starts; messages of a conversation come in any order
        spark.createDataFrame(rows[part::4], conversations.MESSAGES).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
        conversations.follow(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), files=1, **limits).awaitTermination()
    got = conversations.latest(spark, str(tmp_path / "out"))
    names = ["conv_id", "turn", "role", "place", "content"]
    all_rows = spark.createDataFrame(rows, conversations.MESSAGES)
    want = conversation.message_window(all_rows, **limits)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, want.select(names).collect()))
    seen = {c: sum(r[0] == c for r in rows) for c in range(12)}
    assert {(r["conv_id"], r["n_seen"]) for r in got.select("conv_id", "n_seen").distinct().collect()} <= set(seen.items())
    assert all(len({x["snapshot_id"] for x in got.where(F.col("conv_id") == c).collect()}) <= 1 for c in range(12))


def test_copies_are_checked(spark, tmp_path):
    a, b = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    rows = spark.createDataFrame([(1, "x"), (2, None)], "i int, t string")
    key = a.put("t", rows)
    rows.where("i = 1").write.parquet(b.path("t", key))  # a copy that failed: it has rows, but its mark goes
    (tmp_path / "b" / "t" / key[:2] / key[2:4] / key / "_SUCCESS").unlink()
    assert a.copy("t", key, b) and not a.copy("t", key, b)
    assert content_id(b.get("t", key)) == key
    rows.where("i = 2").write.mode("overwrite").parquet(a.path("t", key))
    with pytest.raises(ValueError, match="not what its id names"):
        a.copy("t", key, Store(spark, str(tmp_path / "c")))
