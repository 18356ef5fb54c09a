"""Streams with keyed state: a micro-batch reads and writes the state of the keys that it holds, and of those whose timer ran out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RollingBlock(StatefulProcessor):
    """One source: a ring of its last n - 1 outcomes, and whether it is throttled."""

    def __init__(self, n: int, above: float, below: float):
        self.n, self.above, self.below = n, above, below

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("outcomes", "ring STRING, throttled BOOLEAN")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ring, throttled = self.state.get() if self.state.exists() else ("", False)
        new = pd.concat(list(rows)).sort_values(["created_at", "id"], na_position="first", ignore_index=True)
        blocks = np.concatenate([np.frombuffer(ring.encode(), np.uint8) - 48, new["block"].to_numpy(np.uint8)]).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(blocks)])
        at = np.arange(len(ring) + 1, len(blocks) + 1)  # behind each new outcome
        seen = np.minimum(at, self.n)
        rate = (total[at] - total[at - seen]) / seen
        # what each full window asks for, and the changes that this makes one after another
        asks = np.where(seen < self.n, 0, np.where(rate > self.above, 1, np.where(rate < self.below, -1, 0)))
        said = np.flatnonzero(asks)
        before = np.concatenate([[1 if throttled else -1], asks[said]])
        turns = said[before[1:] != before[:-1]]
        self.state.update(("".join(map(str, blocks[max(0, len(blocks) - self.n + 1) :])), bool(before[-1] == 1)))
        if len(turns):
            out = new.loc[turns, ["id", "created_at"]]
            yield pd.DataFrame({"ats": key[0], "id": out["id"].to_numpy(), "created_at": out["created_at"].to_numpy(), "rate": np.round(rate[turns], 4), "turn": np.where(asks[turns] == 1, "throttle", "recover")})

    def close(self) -> None:
        pass


class StaleRuns(StatefulProcessor):
    """One run: its start, whether it has ended, and a timer for when it should have."""

    def __init__(self, minutes: int):
        self.wait = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("run", "start LONG, ended BOOLEAN")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, ended = self.state.get() if self.state.exists() else (None, False)
        for part in rows:
            first = int(part["at"].astype("datetime64[us]").astype("int64").min())
            start, ended = first if start is None else min(start, first), ended or bool(part["ended"].any())
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(start // 1000 + self.wait + 1)
        self.state.update((start, ended))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, ended = self.state.get()
        self.state.clear()  # a run that goes on after this is a new one
        if not ended:
            yield pd.DataFrame({"run_id": [key[0]], "started_at": [pd.Timestamp(start, unit="us")], "status": ["failed"]})

    def close(self) -> None:
        pass


def start_keyed(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, time_mode: str, path: str, **trigger) -> StreamingQuery:
    """Starts a stream whose appended rows go under path/out. Its state is in RocksDB, whatever the session says."""
    conf = rows.sparkSession.conf
    before = conf.get(STORE, None)
    conf.set(STORE, ROCKS)  # read once, when the query starts
    try:
        out = rows.groupBy(key).transformWithStateInPandas(processor, schema, "Append", time_mode)
        return out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/out").trigger(**(trigger or {"availableNow": True})).start()
    finally:
        conf.unset(STORE) if before is None else conf.set(STORE, before)
