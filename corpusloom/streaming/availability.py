"""Availability states of services over a stream of calls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from corpusloom.operators.conversations import Breaker


def availability_stream(calls: DataFrame, threshold: int = 3, recovery_s: float = 60.0) -> DataFrame:
    """State before and after each call, as the batch operator gives it.

    Input: service long, call_id long, ts timestamp, failed boolean. Per service three figures
    are kept between batches.
    """

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (0, 0.0, False)
        breaker = Breaker(threshold, recovery_s, int(held[0]), float(held[1]), bool(held[2]))
        rows = pd.concat(list(frames)).sort_values(["ts", "call_id"])
        out = [
            (key[0], call_id, *breaker.call(ts.timestamp(), failed))
            for ts, call_id, failed in zip(rows["ts"], rows["call_id"], rows["failed"])
        ]
        state.update((breaker.failures, breaker.last_failure, breaker.is_open))
        yield pd.DataFrame(out, columns=["service", "call_id", "before", "after", "rejected"])

    return calls.groupBy("service").applyInPandasWithState(
        update, "service long, call_id long, before string, after string, rejected boolean",
        "failures int, last_failure double, is_open boolean", "append", "NoTimeout")
