"""Structured Streaming: a session's window vocabulary as keyed state, and call rates by event-time window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.operators import codecs
from textloom.operators.vocab import WINDOW_CAP
from textloom.operators.windows import SessionWindow


OUT = "conv_id long, version long, changed boolean, entries long, top binary"
STATE = "patterns array<binary>, freqs array<long>, savings array<long>, seen array<long>, batches long"


def session_vocabulary(turns: DataFrame, cap: int = WINDOW_CAP, learn_every: int = 1, idle_ms: int | None = None) -> DataFrame:
    """A row for each micro-batch and conversation of a stream of (conv_id, turn, text): the window after its turns, taken
    in turn order; every learn_every-th turn is learned. A conversation without turns for idle_ms is forgotten, by default
    never: then the state grows with the conversations."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            patterns, freqs, savings, seen, batches = state.get
            window = SessionWindow(list(zip(patterns, freqs, savings, seen)), batches, cap)
        else:
            window = SessionWindow(cap=cap)
        changed = False
        turns = pd.concat(list(parts)).sort_values("turn")
        for turn, text in zip(turns["turn"], turns["text"]):
            if turn % learn_every == 0:
                changed |= window.update(codecs.mine((text or "").encode()))
        rows = window.rows()
        state.update(tuple(list(x) for x in (zip(*rows) if rows else ((), (), (), ()))) + (window.batches,))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        best = min((codecs.Entry(p, f, s) for p, f, s, _ in rows), key=codecs.order_of, default=None)
        yield pd.DataFrame({"conv_id": [key[0]], "version": [window.batches], "changed": [changed], "entries": [len(rows)], "top": [best.pattern if best else b""]})

    return turns.groupBy("conv_id").applyInPandasWithState(run, OUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def call_rates(events: DataFrame, width: str = "1 minute", late: str = "10 minutes", most: int = 60) -> DataFrame:
    """(user_id, start, calls, refused) of event-time windows; rows later than the watermark are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = timed.withWatermark("ts", late).groupBy("user_id", F.window("ts", width).alias("w")).agg(F.count("*").alias("calls"))
    return w.select("user_id", F.col("w.start").alias("start"), "calls", (F.col("calls") > most).alias("refused"))


def publish(vocabularies: DataFrame, path: str, checkpoint: str):
    """Writes each micro-batch's vocabulary rows under its own version, so a replayed batch writes the same files again."""

    def write(batch: DataFrame, version: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={version}")

    return vocabularies.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
