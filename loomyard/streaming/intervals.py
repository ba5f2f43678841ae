"""Streaming extensions: interval maps in keyed state, and windowed counts with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.intervals import IntervalMap


def stream_periods(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """A stream of the map of every entity that a micro-batch changed: (entity, version, starts, ends).

    The state of a key is its ordered map of disjoint intervals; rows are inserted in batches by binary search. The row of the
    greatest version is the entity's current map, the gaps are what lies between. Use in update mode. Rows with a null
    or end <= start are ignored.
    """
    kind = df.schema[entity].dataType.simpleString()
    out = f"`{entity}` {kind}, version long, starts array<long>, ends array<long>"

    def insert(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, starts, ends = state.get if state.exists else (0, [], [])
        held = IntervalMap()
        held.insert(np.array(starts, np.int64), np.array(ends, np.int64))
        for p in parts:
            held.insert(p["s"].to_numpy(), p["t"].to_numpy())
        state.update((version + 1, held.starts, held.ends))
        yield pd.DataFrame({entity: [key[0]], "version": [version + 1], "starts": [held.starts], "ends": [held.ends]})

    rows = df.select(F.col(entity), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("t")).where(f"`{entity}` is not null and s < t")
    return rows.groupBy(entity).applyInPandasWithState(insert, out, "version long, starts array<long>, ends array<long>", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(df: DataFrame, at: str, key: str, *, width: str, late: str) -> DataFrame:
    """Tumbling counts and sums-ready groups; rows later than the watermark are dropped."""
    return df.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count("*").alias("n"))


def sessions(df: DataFrame, at: str, key: str, *, gap: str, late: str) -> DataFrame:
    return df.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))
