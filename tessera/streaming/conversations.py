"""Conversations as stream state: each keeps its message window and the ids it began with, over batches and restarts.

State holds only messages that a later window can still want: one that the limits leave out is left out of every later
window too, since what goes before it only grows. So a conversation's state is bounded by the limits, however long it gets.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.conversation import MAX_MESSAGES, MESSAGE_CHARS, TOTAL_CHARS

MESSAGES = "conv_id long, turn long, role string, text string, snapshot_id string"
PACKS = "conv_id long, turn long, role string, place long, content string, snapshot_id string, n_seen long"


def kept(messages: list[dict], max_messages: int, total_chars: int) -> list[dict]:
    """The messages (turn, role, text) that a window takes, in its order of urgency: system ones, then the newest others."""
    urgent = sorted(messages, key=lambda m: (m["role"] != "system", m["turn"] if m["role"] == "system" else -m["turn"]))
    out, before = [], 0
    for m in urgent[:max_messages]:
        if before < total_chars or not m["text"]:
            out.append(m | {"room": max(0, total_chars - before)})
        before += len(m["text"])
    return out


def packed(messages: DataFrame, max_messages: int = MAX_MESSAGES, message_chars: int = MESSAGE_CHARS, total_chars: int = TOTAL_CHARS) -> DataFrame:
    """Of a stream of messages (MESSAGES) the packs (PACKS) of the conversations that a batch has messages of: their
    whole window, the first snapshot id that they came with, and how many messages they have had."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"messages": [], "snapshot": None, "seen": 0}
        for batch in batches:
            new = [{"turn": int(turn), "role": role, "text": (text or "")[:message_chars]} for turn, role, text in zip(batch["turn"], batch["role"], batch["text"])]
            named = batch.sort_values("turn")["snapshot_id"].dropna()
            held["snapshot"] = held["snapshot"] or (named.iloc[0] if len(named) else None)
            held["seen"] += len(new)
            held["messages"] = [{k: m[k] for k in ("turn", "role", "text")} for m in kept(held["messages"] + new, max_messages, total_chars)]
        state.update((json.dumps(held),))
        window = sorted(kept(held["messages"], max_messages, total_chars), key=lambda m: (m["role"] != "system", m["turn"]))
        yield pd.DataFrame([(key[0], m["turn"], m["role"], place, m["text"][: m["room"]], held["snapshot"], held["seen"]) for place, m in enumerate(window)], columns=[c.split()[0] for c in PACKS.split(", ")])

    return messages.groupBy("conv_id").applyInPandasWithState(update, PACKS, "held string", "update", GroupStateTimeout.NoTimeout)


def follow(spark: SparkSession, source: str, target: str, checkpoint: str, files: int = 1000, **limits: int) -> StreamingQuery:
    """Packs of the message files that appear in a folder, up to ``files`` a batch, written to ``target``; a batch that is
    redone replaces what it wrote, and a query that is started again goes on with the state of ``checkpoint``."""
    messages = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", files).parquet(source).where("conv_id is not null and turn is not null")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return packed(messages, **limits).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The newest pack of each conversation that ``follow`` wrote."""
    rows = spark.read.parquet(target).withColumn("batch", F.col("batch").cast("bigint"))
    newest = F.max("batch").over(Window.partitionBy("conv_id"))
    return rows.withColumn("_newest", newest).where("batch = _newest").drop("batch", "_newest")
