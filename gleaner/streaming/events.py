"""Event streams: appended logs, and the last events of each key as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.format(fmt).schema(EVENT_SCHEMA).load(path)


def append_log(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """JSON lines, each event once, also after a restart."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def ring(events: DataFrame, key: str = "event_type", size: int = 2_000) -> DataFrame:
    """(key, event_id, ts_us): the last ``size`` events of each key after each batch,
    oldest dropped first; state is bounded by ``size`` a key."""

    def update(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for part in parts:
            held += zip(part["ts"].astype("datetime64[us]").astype("int64"), part["event_id"], strict=True)
            held = sorted(held)[-size:]
        times, ids = zip(*held, strict=True) if held else ((), ())
        state.update(([int(t) for t in times], [int(i) for i in ids]))
        yield pd.DataFrame({key: name[0], "event_id": list(ids), "ts_us": list(times)})

    return events.select(key, "event_id", "ts").groupBy(key).applyInPandasWithState(update, f"{key} string, event_id long, ts_us long", "times array<long>, ids array<long>", "update", "NoTimeout")
