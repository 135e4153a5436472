"""Streaming measures over alert events. Each takes and returns a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from alertloom.operators.stabbing import interval_index, stab

DELAY = "1 hour"


def alert_burden(calls: DataFrame, window: str = "1 hour", delay: str = DELAY) -> DataFrame:
    """Per tumbling window: events, pages, false pages and missed must-pages.

    `calls`: ts, gold_page_now, paged (NULL when unanswered).
    """
    paged = F.coalesce("paged", F.lit(False))
    g = calls.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(paged).alias("pages"),
        F.count_if(paged & ~F.col("gold_page_now")).alias("false_pages"),
        F.count_if(~paged & F.col("gold_page_now")).alias("missed"),
    )
    return g.select(F.unix_timestamp("w.start").alias("window_start"), "events", "pages", "false_pages", "missed")


def burden_rates(burden: DataFrame) -> DataFrame:
    return burden.withColumn("pages_per_1k", F.round(1000.0 * F.col("pages") / F.col("events"), 6)).withColumn(
        "false_per_1k", F.round(1000.0 * F.col("false_pages") / F.col("events"), 6)
    )


def storm_sessions(events: DataFrame, gap: str = "2 hours", delay: str = DELAY) -> DataFrame:
    """Bursts per (host, signal) closed by a gap of silence: size and time from first to last event.

    Session windows merge inside each map task before the shuffle, so a hot host sends merged
    sessions, not its events.
    """
    s = events.withWatermark("ts", delay).groupBy("host", "signal", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("size"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )
    return _storms(s)


def _storms(sessions: DataFrame) -> DataFrame:
    took = F.unix_micros("last") - F.unix_micros("first")
    return sessions.select("host", "signal", F.unix_micros("first").alias("first_us"), "size", took.alias("duration_us"))


def open_storms(state: DataFrame) -> DataFrame:
    """Bursts that were still open when the stream stopped, out of its stored state."""
    return _storms(state.select("key.host", "key.signal", F.col("value.count").alias("size"), F.col("value.min").alias("first"), F.col("value.max").alias("last")))


def sliding_rate(events: DataFrame, window: str = "1 hour", slide: str = "10 minutes", delay: str = DELAY) -> DataFrame:
    """Recent alerts of the same host per sliding window."""
    g = events.withWatermark("ts", delay).groupBy("host", F.window("ts", window, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("host", F.unix_timestamp("w.start").alias("window_start"), "n")


def open_rates(state: DataFrame) -> DataFrame:
    """Windows that were still open when the stream stopped, out of its stored state."""
    return state.select("key.host", F.unix_timestamp("key.window.start").alias("window_start"), F.col("value.count").alias("n"))


def deduplicate(events: DataFrame, key: str = "case_id", delay: str = DELAY) -> DataFrame:
    """Drop repeats of an event id that arrive within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


# ------------------------------------------------------------------ repeats against open incidents
INCIDENT_HOURS = 48
HEAD = "host string, signal string, minute timestamp, first struct<ts: timestamp, case_id: bigint, impact_rank: int, urgency_rank: int>"
INCIDENT = "host string, signal string, opened timestamp, closes timestamp, case_id bigint, impact_rank int, urgency_rank int"
#: Stands after all minutes of a stream that ends. Pandas counts nanoseconds, so its years end in 2262.
END = "2260-01-01 00:00:00"


def minute_heads(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """The first event of every (host, signal, minute), by time and id: all that decides which events open incidents.

    The minimum combines inside each map task, so a hot host sends one row a minute.
    """
    first = F.min(F.struct("ts", "case_id", "impact_rank", "urgency_rank"))
    g = events.withWatermark("ts", delay).groupBy("host", "signal", F.window("ts", "1 minute").alias("w")).agg(first.alias("first"))
    return g.select("host", "signal", F.col("w.start").alias("minute"), "first")


def open_heads(state: DataFrame) -> DataFrame:
    """Minutes that were still open when the stream stopped, out of its stored state."""
    return state.select("key.host", "key.signal", F.col("key.window.start").alias("minute"), F.col("value.min").alias("first"))


def _chain(held: pd.DataFrame, open_: pd.DataFrame) -> pd.DataFrame:
    """Rows of `held`, sorted by host, signal and minute, that open an incident, all keys at once.

    `open_` (host, signal, opened) is the last incident of each key.
    """
    keys = held[["host", "signal"]].ne(held[["host", "signal"]].shift()) & ~(held[["host", "signal"]].isna() & held[["host", "signal"]].shift().isna())
    new = keys.any(axis=1).to_numpy()
    new[:1] = True
    group = np.cumsum(new) - 1
    at = (group << 32) + held["minute"].to_numpy() // MINUTE
    before = held.loc[new, ["host", "signal"]].merge(open_, on=["host", "signal"], how="left")["opened"]
    # the place of the first minute of each key that no incident of before covers
    wait = INCIDENT_MICROS // MINUTE
    base = np.arange(len(before), dtype=np.int64) << 32
    after = np.where(before.notna(), before.fillna(0).astype("int64") // MINUTE + wait + 1, np.iinfo(np.int32).min)
    ends = np.append(np.flatnonzero(new)[1:], len(held))
    pos = np.searchsorted(at, base + after)
    found = []
    while True:
        live = pos < ends
        pos, ends, base = pos[live], ends[live], base[live]
        if not len(pos):
            return held.iloc[np.sort(np.concatenate(found))] if found else held.iloc[:0]
        found.append(pos)
        pos = np.searchsorted(at, at[pos] + wait + 1)


def _packed(frame: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(value: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(value).read_pandas()


class IncidentChain(StatefulProcessor):
    """Which minutes of a host and signal open an incident: the first, and the first after each incident has closed.

    The state is that of a bucket of hosts and signals: calls into the state cost far more than the rows in it. Minutes wait until
    the watermark has passed them, as they may arrive in any order. An incident stays in the state for
    INCIDENT_HOURS from the minute that opened it; then a timer drops it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "minutes binary")
        self.incident = handle.getValueState("incident", "opened binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            frame = frame[frame["host"].notna()]  # the end of the stream has no host
            if frame.empty:
                continue
            minutes = frame[HELD].assign(minute=micros(frame["minute"]))
            self.waiting.appendValue((_packed(minutes),))
            self.handle.registerTimer(int(minutes["minute"].max()) // 1000)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs() * 1000
        kept = _unpacked(self.incident.get()[0]) if self.incident.exists() else pd.DataFrame({"host": [], "signal": [], "opened": []})
        held = [_unpacked(row[0]) for row in self.waiting.get()] if self.waiting.exists() else []
        held = pd.concat(held, ignore_index=True) if held else pd.DataFrame({c: [] for c in HELD})
        due = held["minute"] <= upto
        out = _chain(held[due].sort_values(["host", "signal", "minute"], ignore_index=True), kept) if due.any() else held.iloc[:0]
        if due.any():
            self.waiting.put([(_packed(held[~due]),)]) if not due.all() else self.waiting.clear()
        last = pd.concat([f for f in (kept, out.rename(columns={"minute": "opened"})[["host", "signal", "opened"]]) if len(f)] or [kept])
        last = last.drop_duplicates(["host", "signal"], keep="last")
        # with no minute left to meet them, all that closed before the watermark go
        past = max(upto, timerValues.getCurrentWatermarkInMs() * 1000) if due.all() else upto
        last = last[last["opened"] + INCIDENT_MICROS >= past]
        if len(last):
            self.incident.update((_packed(last),))
            # the next to close; all that are over by then go with it
            self.handle.registerTimer((int(last["opened"].min()) + INCIDENT_MICROS + MINUTE) // 1000)
        elif len(kept):
            self.incident.clear()
        if len(out):
            opened = out["minute"].astype("int64")
            closes = opened + INCIDENT_MICROS + MINUTE - 1
            yield out.assign(opened=pd.to_datetime(opened, unit="us"), closes=pd.to_datetime(closes, unit="us"))[["host", "signal", "opened", "closes", "case_id", "impact_rank", "urgency_rank"]]
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


HELD = ["host", "signal", "minute", "case_id", "impact_rank", "urgency_rank"]
MINUTE = 60_000_000
INCIDENT_MICROS = INCIDENT_HOURS * 3_600_000_000
#: Minutes of a bucket, on average, where the caller knows how many there are.
BUCKET_ROWS = 10_000


def micros(column: pd.Series) -> np.ndarray:
    return column.to_numpy(dtype="datetime64[us]").astype("int64")


def incident_chain(heads: DataFrame, buckets: int = 1_000) -> DataFrame:
    """Incidents of a stream of minute heads: when each opened, the last instant it covers, and the event that opened it.

    Hosts and signals are dealt to `buckets`, each a key of the state.
    """
    bucket = F.pmod(F.xxhash64("host", "signal"), F.lit(buckets)).alias("bucket")
    ordered = heads.withWatermark("minute", "0 seconds").select(bucket, "host", "signal", "minute", "first.case_id", "first.impact_rank", "first.urgency_rank")
    return ordered.groupBy("bucket").transformWithStateInPandas(IncidentChain(), INCIDENT, "Append", "EventTime")


def attach_repeats(events: DataFrame, incidents: DataFrame) -> DataFrame:
    """Add `opened_by` and `decision` to every event: it opened its incident, joined it, or is worse and was reassessed.

    Incidents of a host and signal don't overlap, and each event lies in one of them. `events` is a table or a stream.
    """
    by = incidents.withColumn("by", F.struct("case_id", "impact_rank", "urgency_rank")).withColumn("number", F.unix_micros("opened"))
    found = stab(events, "ts", interval_index(by, ["host", "signal"], "opened", "closes", "number", "by"), name="_in")
    fits = (F.col("impact_rank") <= F.col("_in.w.impact_rank")) & (F.col("urgency_rank") <= F.col("_in.w.urgency_rank"))
    decision = F.when(F.col("case_id") == F.col("_in.w.case_id"), "opened").when(fits, "attached").otherwise("reassessed")
    return found.withColumn("opened_by", F.col("_in.w.case_id")).withColumn("decision", decision).drop("_in")
