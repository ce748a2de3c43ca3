"""Histories of running conversations: the last messages of each are its state, and a timer clears those that have gone quiet."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators import dialogue
from tessera.sources.scratch import fresh_path

#: Messages that a conversation remembers, and milliseconds without one after which it forgets them.
LAST, QUIET_MS = 8, 30 * 60 * 1000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MESSAGE = "seq bigint, role string, content string"


class Remembered(StatefulProcessor):
    """Gives every message the ones before it. Of a batch's messages the earlier turns go first; one that comes after later ones
    sees only what is before it in turn, and takes its place among what is remembered."""

    def __init__(self, last: int = LAST, quiet_ms: int | None = QUIET_MS):
        self.last, self.quiet_ms = last, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getListState("messages", _MESSAGE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = sorted(tuple(m) for m in self.messages.get()) if self.messages.exists() else []
        said = pd.concat(list(rows)).sort_values("turn", kind="stable")
        out = []
        for turn, role, text in said[["turn", "role", "text"]].itertuples(index=False, name=None):
            before = [m for m in known if m[0] < turn][-self.last :]
            out.append((key[0], turn, role, text, [dict(zip(("seq", "role", "content"), m)) for m in before]))
            known = sorted([*known, (turn, role, text)], key=lambda m: m[0])[-2 * self.last :]
        self.messages.put(known)
        if self.quiet_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "role", "text", "history"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.messages.clear()
        yield pd.DataFrame({"conv_id": [], "turn": [], "role": [], "text": [], "history": []})

    def close(self) -> None:
        pass


def histories(turns: DataFrame, last: int = LAST, quiet_ms: int | None = QUIET_MS) -> DataFrame:
    """What dialogue.history gives, for a stream of turns(conv_id, turn, role, text).

    Null conversations are one. A conversation that was quiet for quiet_ms starts anew (None: never, and no timers are set). What was given out isn't
    revised when a late turn arrives; twice `last` messages are kept, so that it finds its own.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    schema = "conv_id bigint, turn bigint, role string, text string, history array<struct<seq:bigint,role:string,content:string>>"
    return rows.groupBy("conv_id").transformWithStateInPandas(Remembered(last, quiet_ms), outputStructType=schema, outputMode="Append", timeMode="None" if quiet_ms is None else "ProcessingTime")


def run_histories(spark: SparkSession, path: str, last: int = LAST, batch_files: int = 1000) -> DataFrame:
    """All turns that lie under path, taken as a stream to its present end; the result is read from what the stream has written.
    Without timers: with them a stream has no end."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before, out = spark.conf.get(name, None), fresh_path(spark, "histories")
    schema = spark.read.parquet(path).schema
    spark.conf.set(name, PROVIDER)
    try:
        made = histories(spark.readStream.schema(schema).option("maxFilesPerTrigger", batch_files).parquet(f"{path}*"), last, None)
        query = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    query.awaitTermination()
    return spark.read.schema(made.schema).parquet(out)


def batch_histories(turns: DataFrame, last: int = LAST) -> DataFrame:
    """The same of a table that is whole."""
    return dialogue.history(turns, last).select("conv_id", "turn", "role", "text", "history")
