"""Streaming twins: latest-wins within a wait, and tallies of tumbling windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounced(events: DataFrame, group: str, ts: str, order: str, wait_ms: int, lateness: str = "10 seconds") -> DataFrame:
    """Events that no newer one of their group follows within the wait.

    A session window closes once nothing has come for the wait; of each session
    the last event is acted on.  In append mode a session is given out when the
    watermark has passed its end, so late events within ``lateness`` still join it.
    """
    session = F.session_window(ts, f"{wait_ms} milliseconds")
    last = events.withWatermark(ts, lateness).groupBy(group, session).agg(F.max(F.struct(ts, order)).alias("last"), F.count("*").alias("merged"))
    return last.select(group, F.col(f"last.{order}").alias(order), F.col(f"last.{ts}").alias(ts), "merged")


def tallies(events: DataFrame, ts: str, key: str, value: str, size: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Count, sum and greatest value by tumbling window and key."""
    return events.withWatermark(ts, lateness).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(20,4)")).cast("double").alias("total"), F.max(value).alias("most")).select(F.col("window.start").alias("start"), key, "n", "total", "most")


def growth(events: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Each event with the value of the one before it in its group, by state that is kept between batches."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        prior = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(order)
        out = []
        for o, v in zip(rows[order], rows[value], strict=True):
            out.append((key[0], o, v, prior))
            prior = float(v)
        state.update((prior,))
        yield pd.DataFrame(out, columns=[group, order, value, "prior"]).astype({"prior": "float64"})

    schema = f"{group} long, {order} long, {value} double, prior double"
    return events.groupBy(group).applyInPandasWithState(run, schema, "prior double", "append", "NoTimeout")
