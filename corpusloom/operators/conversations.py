"""Messages, turns, sessions, histories and calls to a service."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions import labels, text as X
from corpusloom.operators.ranking import top_per_key
from corpusloom.session import written


def pair_turns(messages: DataFrame) -> DataFrame:
    """Each assistant message with the user message right before it, else ``(unknown)``."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    before_role, before_text = F.lag("role").over(order), F.lag("text").over(order)
    question = F.when(before_role == "user", before_text).otherwise("(unknown)")
    rows = messages.withColumn("question", question).filter(F.col("role") == "assistant")
    return rows.withColumnRenamed("text", "answer")


def session_history(turns: DataFrame, session_id=None) -> DataFrame:
    """Indexed turns with the session's first and last times."""
    if session_id is not None:
        turns = turns.filter(F.col("session_id") == session_id)
    whole = Window.partitionBy("session_id")
    index = F.row_number().over(whole.orderBy("turn_no")) - 1
    return turns.select("session_id", index.alias("index"), "question", "answer", "query_type", "ts_s",
                        F.min("ts_s").over(whole).alias("created_at"), F.max("ts_s").over(whole).alias("last_activity"))


def recent_turns(turns: DataFrame, cap: int = C.TURNS_CAP) -> DataFrame:
    """The last turns of each session."""
    return top_per_key(turns, ["session_id"], [F.desc("turn_no")], cap)


def history_context(turns: DataFrame, summaries: DataFrame | None = None, recent: int = C.RECENT_TURNS,
                    answer_chars: int = 300, total_chars: int = C.HISTORY_CHARS, speaker: str = "Assistant") -> DataFrame:
    """History text per session: the summary, then the last turns with clipped answers; its tail
    is kept when it is too long."""
    head = X.rstrip(F.left(F.col("answer"), F.lit(answer_chars)))
    preview = F.concat(head, F.when(F.length("answer") > answer_chars, "...").otherwise(""))
    rows = recent_turns(turns, recent).withColumn(
        "piece", F.concat(F.lit("[User]: "), "question", F.lit(f"\n[{speaker}]: "), preview))
    joined = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn_no", "piece"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["piece"]), "\n\n")
    if summaries is not None:
        joined = joined.join(summaries.select("session_id", "summary"), "session_id", "left")
        body = F.concat_ws("\n\n", F.when(F.coalesce("summary", F.lit("")) != "",
                                          F.concat(F.lit("[Summary of earlier conversation]\n"), "summary")), body)
    return joined.select("session_id", F.right(body, F.lit(total_chars)).alias("history"))


def session_sizes(turns: DataFrame, min_turns: int = C.COMPRESS_MIN_TURNS, min_chars: int = C.COMPRESS_MIN_CHARS) -> DataFrame:
    """Turns and characters per session, and whether it should be summarised."""
    sized = turns.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("turns"), F.sum(F.length("question") + F.length("answer")).alias("chars"))
    return sized.withColumn("compress", (F.col("turns") >= min_turns) & (F.col("chars") >= min_chars))


#: Turns of a session that are folded in one piece.
SLOT_TURNS = 64
_NAMES = "array<string>"


def _none() -> Column:
    return F.array().cast(_NAMES)


def _remember(known: Column, named: Column, cap: int) -> Column:
    """Entities known after a turn: the new ones of the turn go last, and the oldest beyond ``cap`` go once the turn is over."""
    longer = F.concat(known, F.array_except(named, known))
    return F.slice(longer, F.greatest(F.lit(1), F.size(longer) - cap + 1), cap)


def _slots(turns: DataFrame, cap: int, slot_turns: int) -> DataFrame:
    """(session_id, slot, said, entry): the turns of each slot of a session and the entities known before the slot.

    What is known depends on all earlier turns, but only through at most ``cap`` names. So a session is cut
    into slots, and slots are folded at the same time, each from a guess: the last names first said in earlier
    slots, which is right as long as no name was ever dropped. Slots whose guess differs from what the slot
    before ends with are folded again from there, until none differs. No group is larger than a slot, and
    a round costs only the slots that changed.
    """
    named = F.array_compact(F.coalesce("entities", _none()))
    rows = turns.select("session_id", "turn_no", F.floor(F.col("turn_no") / slot_turns).alias("slot"), named.alias("named"))
    said = rows.groupBy("session_id", "slot").agg(F.array_sort(F.collect_list(F.struct("turn_no", "named"))).alias("said"))
    said = written(said)
    by_slot = Window.partitionBy("session_id").orderBy("slot")

    names = said.select("session_id", "slot", F.posexplode(F.array_distinct(F.flatten(F.transform("said", lambda t: t["named"])))).alias("at", "name"))
    first = names.groupBy("session_id", "name").agg(F.min(F.struct("slot", "at")).alias("first"))
    place = F.row_number().over(Window.partitionBy("session_id", F.col("first.slot")).orderBy(F.desc("first.at")))
    newest = first.withColumn("__place", place).filter(F.col("__place") <= cap)
    fresh = newest.groupBy("session_id", F.col("first.slot").alias("slot")).agg(F.array_sort(F.collect_list(F.struct(F.col("first.at").alias("at"), "name"))).alias("new"))
    recent = F.flatten(F.collect_list(F.transform("new", lambda n: n["name"])).over(by_slot.rowsBetween(-cap, 0)))
    after = fresh.select("session_id", "slot", F.slice(recent, F.greatest(F.lit(1), F.size(recent) - cap + 1), cap).alias("after"))
    guess = F.last("after", ignorenulls=True).over(by_slot.rowsBetween(Window.unboundedPreceding, -1))
    state = said.join(after, ["session_id", "slot"], "left").select("session_id", "slot", "said", F.coalesce(guess, _none()).alias("entry"))

    def folded(df: DataFrame) -> DataFrame:
        end = F.aggregate("said", F.col("entry"), lambda known, turn: _remember(known, turn["named"], cap))
        return df.select("session_id", "slot", "entry", end.alias("end"))

    state = written(folded(state))
    while True:
        before = F.coalesce(F.lag("end").over(by_slot), _none())
        checked = state.withColumn("before", before)
        wrong = checked.filter(F.col("entry") != F.col("before")).select("session_id", "slot", F.col("before").alias("entry"))
        if wrong.isEmpty():
            return said.join(state, ["session_id", "slot"])
        again = folded(said.join(wrong, ["session_id", "slot"]))
        state = written(state.join(wrong, ["session_id", "slot"], "left_anti").unionByName(again))


def accumulated_entities(turns: DataFrame, cap: int = C.ENTITY_CAP, slot_turns: int = SLOT_TURNS) -> DataFrame:
    """Entities that a session still knows after its last turn, in the order they came in, at most ``cap`` of them."""
    known = _slots(turns, cap, slot_turns).groupBy("session_id").agg(F.max_by("end", "slot").alias("known"))
    return known.select("session_id", F.posexplode("known").alias("p", "entity")).select("session_id", (F.col("p") + 1).alias("place"), "entity")


def entities_before(turns: DataFrame, cap: int = C.ENTITY_CAP, slot_turns: int = SLOT_TURNS) -> DataFrame:
    """Adds ``known``, the entities that the session knows before each turn, in the order they came in, and ``last_entities``,
    those of the turn before (null in the first turn). Turns of a session have numbers of their own."""
    slots = _slots(turns, cap, slot_turns)
    start = F.struct(F.col("entry").alias("now"), F.array().cast(f"array<{_NAMES}>").alias("seen"))

    def step(acc: Column, turn: Column) -> Column:
        return F.struct(_remember(acc["now"], turn["named"], cap).alias("now"), F.array_append(acc["seen"], acc["now"]).alias("seen"))

    seen = F.aggregate("said", start, step)["seen"]
    last = F.get("said", F.size("said") - 1)["named"]
    carried = F.lag(last).over(Window.partitionBy("session_id").orderBy("slot"))
    slots = slots.select("session_id", "said", seen.alias("seen"), carried.alias("carried"))
    rows = slots.select("session_id", "said", "carried", F.posexplode("seen").alias("p", "known"))
    previous = F.when(F.col("p") > 0, F.get("said", F.col("p") - 1)["named"]).otherwise(F.col("carried"))
    rows = rows.select("session_id", F.get("said", F.col("p"))["turn_no"].alias("turn_no"), "known", previous.alias("last_entities"))
    return turns.join(rows, ["session_id", "turn_no"])


def resolve_coreference(turns: DataFrame, words=C.REFERRING_WORDS, cap: int = C.ENTITY_CAP) -> DataFrame:
    """Questions that refer back get the last turn's first entity as a prefix."""
    rows = entities_before(turns, cap)
    pattern = r"(?iu)\b(?:" + "|".join(words) + r")\b"
    question = F.lower("question")
    recent = F.slice("known", F.greatest(F.lit(1), F.size("known") - 4), 5)
    named = F.exists(recent, lambda e: F.contains(question, F.lower(e)))
    refers = F.col("question").rlike(pattern) & (F.coalesce(F.size("last_entities"), F.lit(0)) > 0) & ~named
    resolved = F.when(refers, F.concat(F.lit("[Referring to "), F.get("last_entities", F.lit(0)), F.lit("] "), "question"))
    return rows.withColumn("resolved", F.coalesce(resolved, F.col("question"))).drop("known", "last_entities")


def cache_history(cache: DataFrame, chars: int = 500) -> DataFrame:
    """Cached answers, newest first, with shortened source texts and the first region."""
    short = F.transform("sources", lambda s: F.struct(
        s["title"].alias("title"), s["score"].alias("score"), F.left(s["full_text"], F.lit(chars)).alias("text"),
        F.get(s["regions"], F.lit(0)).alias("region")))
    return cache.select("entry_id", "question", "answer", "ts_s", short.alias("sources")).orderBy(F.desc("ts_s"))


def extract_citations(df: DataFrame, answer_col: str = "answer", key: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """Cited sources with the sentence before the citation; relation marks are removed first."""
    text = F.regexp_replace(answer_col, r"\[Relation: .*?\]", "")
    pattern = r"([^.。\n]+?)\s*\[Source:\s*([^\]]+)\]"
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.transform(matches, lambda m: F.struct(
        F.substring_index(m, "[Source:", 1).alias("sentence"), F.regexp_extract(m, r"\[Source:\s*([^\]]+)\]$", 1).alias("source")))
    return df.select(*key, F.posexplode(pairs).alias("citation_no", "c")).select(
        *key, "citation_no", X.strip(F.col("c.sentence")).alias("sentence"), F.col("c.source").alias("source"))


def source_registry(answers: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Distinct cited documents with their uses, by type and region."""
    return answers.groupBy(doc, "title", "entity_type", "region").agg(F.count(F.lit(1)).alias("uses"))


def conversation_index(messages: DataFrame, turns: DataFrame, reference_ts: Column) -> DataFrame:
    """Per conversation: date label, first question, last query type."""
    first = messages.groupBy("conv_id").agg(
        F.min("ts").alias("started_at"),
        F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("first_question"))
    typed = F.when(F.col("query_type") != "", F.col("turn_no"))
    last = turns.groupBy(F.col("session_id").alias("conv_id")).agg(F.max_by("query_type", typed).alias("last_query_type"))
    rows = first.join(last, "conv_id", "left")
    return rows.select(
        "conv_id", labels.date_bucket(F.col("started_at"), reference_ts).alias("label"),
        F.coalesce("first_question", F.lit("(empty conversation)")).alias("first_question"),
        F.coalesce("last_query_type", F.lit("FACTUAL")).alias("last_query_type"))


def label_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("label").agg(F.count(F.lit(1)).alias("conversations"))


def _running_count(df: DataFrame, key: str, slot: Column, order: list[str], flag: Column, out: str) -> DataFrame:
    """Running sum of a flag per key in two levels: inside a slot of the key's time line, and over
    the slot totals. One busy key is spread over as many tasks as it has slots."""
    placed = df.withColumn("__slot", slot).withColumn("__flag", flag.cast("long"))
    inside = Window.partitionBy(key, "__slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy(key, "__slot").agg(F.sum("__flag").alias("__sum"))
    ahead = Window.partitionBy(key).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(key, "__slot", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__offset"))
    counted = placed.withColumn("__inside", F.sum("__flag").over(inside)).join(offsets, [key, "__slot"])
    return counted.withColumn(out, F.col("__inside") + F.col("__offset")).drop("__slot", "__flag", "__inside", "__offset")


def _time_slot(ts: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))


def sessionize(df: DataFrame, user: str = "user_id", ts: str = "ts", gap_seconds: int = C.SESSION_IDLE_SECONDS, tie: str = "event_id",
               slot_seconds: int = 86_400) -> DataFrame:
    """Adds ``session_no``: a new session starts after an idle gap longer than the limit.

    The time line of a user is cut into slots. Gaps inside a slot come from a window over the
    slot; the first event of a slot is compared with the last one of the user's slot before.
    """
    slot = _time_slot(ts, slot_seconds)
    placed = df.withColumn("__slot", slot)
    edges = placed.groupBy(user, "__slot").agg(F.max(ts).alias("__last"))
    before = edges.select(user, "__slot", F.lag("__last").over(Window.partitionBy(user).orderBy("__slot")).alias("__before"))
    inside = Window.partitionBy(user, "__slot").orderBy(ts, tie)
    rows = placed.withColumn("__previous", F.lag(ts).over(inside)).join(before, [user, "__slot"])
    gap = F.timestamp_diff("MICROSECOND", F.coalesce("__previous", "__before"), F.col(ts))
    rows = rows.withColumn("__new", gap.isNull() | (gap > gap_seconds * 1_000_000)).drop("__slot", "__previous", "__before")
    return _running_count(rows, user, slot, [ts, tie], F.col("__new"), "session_no").drop("__new")


def session_summary(df: DataFrame, user: str = "user_id", ts: str = "ts", gap_seconds: int = C.SESSION_IDLE_SECONDS) -> DataFrame:
    return sessionize(df, user, ts, gap_seconds).groupBy(user, "session_no").agg(
        F.count(F.lit(1)).alias("events"), F.min(ts).alias("started_at"), F.max(ts).alias("last_activity"))


def failure_streaks(calls: DataFrame, threshold: int = 3, service: str = "user_id", ts: str = "ts", tie: str = "event_id",
                    failed: Column | None = None, slot_seconds: int = 86_400) -> DataFrame:
    """Runs of at least ``threshold`` consecutive failures per service."""
    failed = F.col("event_type") == "error" if failed is None else failed
    rows = calls.select(service, ts, tie, failed.alias("failed"))
    rows = _running_count(rows, service, _time_slot(ts, slot_seconds), [ts, tie], ~F.col("failed"), "__good")
    return rows.filter("failed").groupBy(service, "__good").agg(
        F.count(F.lit(1)).alias("failures"), F.min(tie).alias("first_call"), F.max(tie).alias("last_call")
    ).filter(F.col("failures") >= threshold).drop("__good")


#: State of a service between calls: failures in a row, time of the last one in microseconds, open or not.
_STATE = "struct<failures:int,last:bigint,open:boolean>"


def segment(at: list[int], failed: list[bool], threshold: int, recovery: int) -> tuple[list[tuple], list[int], list[tuple]]:
    """What a stretch of calls does to any state: the end state for each number of failures before it while closed, and for
    an open state the end states by the time it may be tried again (first ``until`` that is not before it; none: it stays open).

    It is found from the last call backwards. An open state only decides which call is let through first, so
    times with the same end are one entry.
    """
    n = len(at)
    following = np.searchsorted(np.asarray(at, np.int64), np.asarray(at, np.int64) + recovery).tolist()
    closed: list[tuple] = [(f, 0, False) for f in range(threshold)]
    tried: list[tuple] = [()] * n
    for i in range(n - 1, -1, -1):
        if failed[i]:
            opened = tried[following[i]] if following[i] < n else (threshold, at[i], True)
            closed = [opened if f + 1 >= threshold else closed[f + 1] for f in range(threshold)]
            tried[i] = opened
        else:
            closed = [closed[0]] * threshold
            tried[i] = closed[0]
    until, ends = [], []
    for i in range(min(n, following[0] + 1)):
        if ends and ends[-1] == tried[i]:
            until[-1] = at[i]
        else:
            until.append(at[i])
            ends.append(tried[i])
    return closed, until, ends


def _carried(pieces: pd.DataFrame, recovery: int) -> list[tuple]:
    """The state in which each stretch of a service begins, from what the stretches do."""
    state, out = (0, 0, False), []
    fixed = lambda s: (int(s["failures"]), int(s["last"]), bool(s["open"]))
    for closed, until, ends in pieces[["closed", "until", "ends"]].itertuples(index=False):
        out.append(state)
        if not state[2]:
            state = fixed(closed[state[0]])
        else:
            k = int(np.searchsorted(np.asarray(until, np.int64), state[1] + recovery))
            state = fixed(ends[k]) if k < len(ends) else state
    return out


def availability(calls: DataFrame, threshold: int = 3, recovery_s: float = 60.0, service: str = "user_id",
                 ts: str = "ts", tie: str = "event_id", failed: Column | None = None, parts: int | None = None) -> DataFrame:
    """State before and after each call of a service: closed, open or half_open; calls that meet
    an open state are rejected.

    The state depends on every earlier call. Calls are dealt out by range of (service, time), so a busy
    service lies in several stretches. What a stretch does to any state it may begin in is a small table
    (``segment``); the tables of a service are applied one after the other, and then all stretches are
    read at the same time, each from the state it really begins in, with one small state in memory.
    ``parts`` sets the number of ranges (Spark's own choice by default).
    """
    failed = F.col("event_type") == "error" if failed is None else failed
    recovery = round(recovery_s * 1_000_000)
    rows = calls.select(F.col(service).alias("service"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"),
                        F.col(tie).alias("call_id"), failed.alias("failed"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    order = ["service", "at", "call_id"]
    dealt = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    placed = written(dealt.withColumn("part", F.spark_partition_id()))
    pieces = placed.groupBy("service", "part").agg(F.count(F.lit(1)).alias("n"))
    several = pieces.groupBy("service").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("service")

    def summary(group: pa.Table) -> pa.Table:
        group = group.sort_by([("at", "ascending"), ("call_id", "ascending")])
        figures = segment(group.column("at").to_pylist(), group.column("failed").to_pylist(), threshold, recovery)
        states = pa.list_(pa.struct([("failures", pa.int32()), ("last", pa.int64()), ("open", pa.bool_())]))
        named = [pa.array([x], t) for x, t in zip(figures, (states, pa.list_(pa.int64()), states))]
        return pa.Table.from_arrays([group.column("service").slice(0, 1), group.column("part").slice(0, 1), *named], names=["service", "part", "closed", "until", "ends"])

    shared = placed.join(several, "service", "left_semi").groupBy("service", "part")
    tables = shared.applyInArrow(summary, f"service {kinds['service']}, part int, closed array<{_STATE}>, until array<bigint>, ends array<{_STATE}>")

    def begin(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        states = _carried(group, recovery)
        return pd.DataFrame({"service": group["service"].values, "part": group["part"].values, "failures": [s[0] for s in states],
                             "last": [s[1] for s in states], "open": [s[2] for s in states]})

    entries = tables.groupBy("service").applyInPandas(begin, f"service {kinds['service']}, part int, failures int, last bigint, open boolean")
    known = placed.join(entries, ["service", "part"], "left").fillna({"failures": 0, "last": 0, "open": False})
    ordered = known.repartition("service", "part").sortWithinPartitions("service", "part", "at", "call_id")
    ordered = ordered.select("service", "part", "at", "call_id", "failed", "failures", "last", "open")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, breaker = None, Breaker(threshold, recovery)
        for batch in batches:
            out = []
            for name, part, at, call_id, bad, failures, last, is_open in batch.itertuples(index=False):
                if (name, part) != now:
                    now, breaker = (name, part), Breaker(threshold, recovery, int(failures), int(last), bool(is_open))
                out.append((name, call_id, *breaker.call(at, bad)))
            yield pd.DataFrame(out, columns=["service", "call_id", "before", "after", "rejected"])

    return ordered.mapInPandas(
        walk, f"service {kinds['service']}, call_id {kinds['call_id']}, before string, after string, rejected boolean")


class Breaker:
    """State of one service: failures in a row and the time of the last one, in the unit of ``recovery_s``."""

    def __init__(self, threshold: int = 3, recovery_s: float = 60.0, failures: int = 0, last_failure: float = 0.0, is_open: bool = False):
        self.threshold, self.recovery_s = threshold, recovery_s
        self.failures, self.last_failure, self.is_open = failures, last_failure, is_open

    def state(self, now: float) -> str:
        if not self.is_open:
            return "closed"
        return "half_open" if now - self.last_failure >= self.recovery_s else "open"

    def call(self, now: float, failed: bool) -> tuple[str, str, bool]:
        before = self.state(now)
        if before == "open":
            return before, before, True
        if failed:
            self.failures, self.last_failure = self.failures + 1, now
            self.is_open = self.failures >= self.threshold
        else:
            self.failures, self.is_open = 0, False
        return before, self.state(now), False
