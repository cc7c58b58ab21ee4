"""Admission, budgets and conversation memory with keyed state, and retention in foreachBatch.

The same decisions as the folds in `gleaner.operators.admission`, for events that arrive in order within a key. State
holds what was admitted and is still within its window, so it is bounded by the limit, not by the traffic.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class _Sliding(StatefulProcessor):
    def __init__(self, limit: int, window_s: float):
        self.limit, self.window = limit, window_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getValueState("live", "times array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        live = list(self.live.get()[0]) if self.live.exists() else []
        for pdf in rows:
            out = []
            for r in pdf.sort_values(["ts", "id"]).itertuples(index=False):
                live = [t for t in live if t > r.ts - self.window]
                if len(live) < self.limit:
                    live.append(r.ts)
                    out.append((key[0], r.id, r.ts, True, 0))
                else:
                    out.append((key[0], r.id, r.ts, False, max(1, math.ceil(live[0] + self.window - r.ts))))
            yield pd.DataFrame(out, columns=["client", "id", "ts", "admitted", "retry_after"])
        self.live.update((live,))

    def close(self) -> None:
        pass


def sliding_admission(requests: DataFrame, limit: int, window_s: float) -> DataFrame:
    """(client, id, ts, admitted, retry_after) for a stream (client string, id long, ts double). Needs the RocksDB state store."""
    return requests.groupBy("client").transformWithStateInPandas(_Sliding(limit, window_s), "client string, id long, ts double, admitted boolean, retry_after int", "Append", "None")


class _Budget(StatefulProcessor):
    def __init__(self, daily: int, monthly: int):
        self.daily, self.monthly = daily, monthly

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "day string, today long, month string, total long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        day, today, month, total = self.used.get() if self.used.exists() else ("", 0, "", 0)
        for pdf in rows:
            out = []
            for r in pdf.sort_values(["ts", "id"]).itertuples(index=False):
                own = r.ts.strftime("%Y-%m-%d")
                if own[:7] != month:
                    month, total = own[:7], 0  # earlier months are gone
                if own != day:
                    day, today = own, 0
                fits = today + r.units <= self.daily and total + r.units <= self.monthly
                today, total = today + r.units * fits, total + r.units * fits
                out.append((key[0], r.id, own, int(r.units), bool(fits)))
            yield pd.DataFrame(out, columns=["category", "id", "day", "units", "admitted"])
        self.used.update((day, int(today), month, int(total)))

    def close(self) -> None:
        pass


def reserve_budget(requests: DataFrame, daily: int, monthly: int) -> DataFrame:
    """(category, id, day, units, admitted) for a stream (category string, id long, ts timestamp, units long)."""
    return requests.groupBy("category").transformWithStateInPandas(_Budget(daily, monthly), "category string, id long, day string, units long, admitted boolean", "Append", "None")


def conversation_memory(turns: DataFrame, keep: int = 4, ttl_s: int = 3600) -> DataFrame:
    """(conv_id, turn, topic, intent, remembered) for a stream (conv_id long, turn long, topic string, intent string).

    remembered is how many contexts are held after the turn: consecutive equal ones are one, at most `keep`. A turn
    without a topic takes the last one. A conversation that is silent for `ttl_s` seconds is forgotten.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = [tuple(x.split("\x1f")) for x in state.get[0]] if state.exists else []
        for pdf in batches:
            out = []
            for r in pdf.sort_values("turn").itertuples(index=False):
                topic = r.topic or (held[-1][0] if held else "")
                context = (topic, r.intent or (held[-1][1] if held else ""))
                if not held or held[-1] != context:
                    held = [*held, context][-keep:]
                out.append((key[0], r.turn, *context, len(held)))
            yield pd.DataFrame(out, columns=["conv_id", "turn", "topic", "intent", "remembered"])
        state.update((["\x1f".join(c) for c in held],))
        state.setTimeoutDuration(ttl_s * 1000)

    return turns.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turn long, topic string, intent string, remembered int", "held array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def first_requests(requests: DataFrame, keys: list[str], time_col: str, delay: str) -> DataFrame:
    """Idempotent create on a stream: the first request of each key, remembered for the watermark's delay."""
    return requests.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def retain(path: str, n: int, order_col: str, every: int = 10) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a log of the latest n rows, bounded by n rows and `every` batches.

    Each batch's latest rows are appended as a folder of their own, which a repeated batch replaces. Every so many
    batches the log is compacted: its latest n rows are written to a new folder, then the folders they came from go.
    compacted() reads the log at any time; rows that are in an old and a new folder for a moment count once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.orderBy(F.desc(order_col)).limit(n).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if batch_id % every != every - 1:
            return
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        old = [f.getPath() for f in files.listStatus(place) if f.getPath().getName().startswith("batch=") and f.getPath().getName() != f"batch={batch_id}.all"]
        compacted(spark.read.parquet(path).drop("batch"), n, order_col).write.mode("overwrite").parquet(f"{path}/batch={batch_id}.all")
        for folder in old:
            files.delete(folder, True)

    return write


def compacted(log: DataFrame, n: int, order_col: str) -> DataFrame:
    """The latest n rows of a log of batches."""
    from gleaner.operators.logs import keep_latest

    rows = log.drop("batch") if "batch" in log.columns else log
    return keep_latest(rows.dropDuplicates([order_col]), n, order_col)


def windowed_counts(events: DataFrame, time_col: str, width: str, delay: str, keys: list[str]) -> DataFrame:
    """Extension: tumbling event-time windows with a watermark."""
    return events.withWatermark(time_col, delay).groupBy(F.window(time_col, width), *keys).agg(F.count("*").alias("n"))
