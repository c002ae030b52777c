"""Keyed state with expiry, and alerts routed to subscribers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state with timers needs; set it on the session before the stream starts.
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Suppressor(StatefulProcessor):
    """Lets an alert of a key pass when `seconds` have gone by since the last one that passed, and forgets the key after that time.

    Once the watermark is `seconds` past the last alert, the next one passes anyway, so its state isn't needed: a timer takes it away.
    """

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField("micros", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        last = self.last.get()[0] if self.last.exists() else None
        before, fired = last, []
        for ts in sorted(t for pdf in rows for t in pdf["ts"]):
            at = ts.value // 1000
            if last is None or at - last >= self.seconds * 1_000_000:
                fired.append(ts)
                last = at
        if last != before:
            if before is not None:
                self.handle.deleteTimer(self._due(before))
            self.last.update((last,))
            self.handle.registerTimer(self._due(last))
        if fired:
            yield pd.DataFrame({"key": [key[0]] * len(fired), "ts": pd.Series(fired, dtype="datetime64[ns]")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass

    def _due(self, micros: int) -> int:
        return micros // 1000 + self.seconds * 1000


def suppress_with_expiry(alerts: DataFrame, seconds: int = 60, late: str | None = "1 minute") -> DataFrame:
    """ST2 on a stream: alerts (key string, ts timestamp) that come `seconds` or more after the last fired one of their key.

    The state holds the keys that fired within the last `seconds` of event time. Alerts without a time are left out, and those
    that come later than `late` are dropped (None: the stream has its watermark already). The session needs PROVIDER.
    """
    timed = alerts.filter("ts is not null").withWatermark("ts", late) if late else alerts
    return timed.groupBy("key").transformWithStateInPandas(Suppressor(seconds), "key string, ts timestamp", "Append", "EventTime")


def route(alerts: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """ST3: alerts, with a column type, for each subscriber (subscriber, topic) of that type; a null topic takes all, a subscriber hears once."""
    every = subscriptions.filter("topic is null").select("subscriber").distinct()
    named = subscriptions.filter("topic is not null").join(every, "subscriber", "left_anti").distinct()
    # two joins rather than one on a condition with OR, which couldn't be dealt by topic
    some = alerts.join(named.withColumnRenamed("topic", "type"), "type")
    return some.unionByName(alerts.join(every))


def deliver(alerts: DataFrame, subscriptions: DataFrame, path: str, checkpoint: str):
    """A writer of routed alerts: a batch goes to the folder of its number, which it replaces, so a batch that is replayed adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        route(batch, subscriptions).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return alerts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def delivered(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")
