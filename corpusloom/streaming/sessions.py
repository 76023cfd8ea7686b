"""Sessions over streams: idle windows and bounded per-session state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import constants as C


def sessionize_stream(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Sessions closed by an idle gap: count, first and last event, once the watermark has passed."""
    windows = events.withWatermark(ts, delay).groupBy(user, F.session_window(ts, gap).alias("w"))
    return windows.agg(F.count(F.lit(1)).alias("events"), F.min(ts).alias("started_at"), F.max(ts).alias("last_activity")).drop("w")


def fold_session(state: tuple[list[int], list[str]], turns: list[tuple[int, list[str]]], turn_cap: int = C.TURNS_CAP,
                 entity_cap: int = C.ENTITY_CAP) -> tuple[list[int], list[str]]:
    """Sizes of the kept turns and the accumulated entities after some more turns in order."""
    sizes, entities = list(state[0]), list(state[1])
    for size, named in turns:
        sizes = [*sizes, size][-turn_cap:]
        entities = [*entities, *[e for e in dict.fromkeys(named) if e not in entities]][-entity_cap:]
    return sizes, entities


def session_state(turns: DataFrame, idle_seconds: int = C.SESSION_IDLE_SECONDS, delay: str = "10 minutes",
                  turn_cap: int = C.TURNS_CAP, entity_cap: int = C.ENTITY_CAP, min_turns: int = C.COMPRESS_MIN_TURNS,
                  min_chars: int = C.COMPRESS_MIN_CHARS) -> DataFrame:
    """State of each session after every batch that touched it, and a row when it expires.

    Input: session_id long, turn_no long, question, answer, entities array<string>, ts timestamp.
    The state of a session is bounded by the caps whatever the length of the conversation; it is
    dropped by an event-time timeout after the idle limit.
    """

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            sizes, entities, _ = state.get
            state.remove()
            yield row(key[0], sizes, list(entities), True)
            return
        sizes, entities, last = state.get if state.exists else ([], [], 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "turn_no"])
        fresh = [(len(q) + len(a), list(e)) for q, a, e in zip(rows["question"], rows["answer"], rows["entities"])]
        sizes, entities = fold_session((list(sizes), list(entities)), fresh, turn_cap, entity_cap)
        last = max(int(last), int(rows["ts"].max().timestamp() * 1000))
        state.update((sizes, entities, last))
        state.setTimeoutTimestamp(max(last + idle_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield row(key[0], sizes, entities, False)

    def row(session, sizes, entities, expired) -> pd.DataFrame:
        chars = int(sum(sizes))
        return pd.DataFrame({"session_id": [session], "turns": [len(sizes)], "chars": [chars], "entities": [list(entities)],
                             "compress": [len(sizes) >= min_turns and chars >= min_chars], "expired": [expired]})

    return turns.withWatermark("ts", delay).groupBy("session_id").applyInPandasWithState(
        update, "session_id long, turns int, chars int, entities array<string>, compress boolean, expired boolean",
        "sizes array<int>, entities array<string>, last long", "update", "EventTimeTimeout")
