"""Streams against plain Python: open tails, incident chains and the state they leave behind."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from alertloom.session import work_path
from alertloom.streaming import operators as so
from alertloom.streaming import runner as rn

EVENT = "case_id long, ts timestamp, host string, signal string, impact_rank int, urgency_rank int"
START = dt.datetime(2024, 5, 1)


def events_of(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = START + dt.timedelta(hours=rng.choice([0, 1, 47, 48, 49, 96, 97, 400]), minutes=rng.randrange(3), microseconds=rng.choice([0, 1, 30_000_000]))
        out.append((i, at, rng.choice("ab"), rng.choice("xy"), rng.randrange(1, 5), rng.randrange(1, 5)))
    return out


def stream(spark, rows, files=1):
    path = work_path(spark, "events")
    for part in range(files):
        spark.createDataFrame(rows[part::files], EVENT).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.createDataFrame([], EVENT).schema).parquet(path)


def plain_decisions(rows):
    minute = lambda t: t.replace(second=0, microsecond=0)
    out = {}
    for key in {(r[2], r[3]) for r in rows}:
        own = sorted((r for r in rows if (r[2], r[3]) == key), key=lambda r: (r[1], r[0]))
        opened, by = None, None
        for r in own:
            if opened is None or minute(r[1]) > opened + dt.timedelta(hours=so.INCIDENT_HOURS):
                opened, by = minute(r[1]), r
            out[r[0]] = (by[0], "opened" if r is by else "attached" if r[4] <= by[4] and r[5] <= by[5] else "reassessed")
    return out


def test_every_event_meets_its_incident_and_none_stays_in_the_state(spark):
    rows = events_of(1, 250)
    heads = rn.run_append(so.minute_heads(stream(spark, rows)), "heads", so.open_heads)
    assert heads.count() == len({(r[2], r[3], r[1].replace(second=0, microsecond=0)) for r in rows})
    path, state = work_path(spark, "minutes"), work_path(spark, "chain-state")
    end = spark.range(1).select(F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("signal"), F.lit(so.END).cast("timestamp").alias("minute"))

    def run():
        with rn.stores_on_disk(spark):
            chain = so.incident_chain(spark.readStream.schema(so.HEAD).parquet(path))
            chain.writeStream.outputMode("append").format("parquet").option("path", path + "-out").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
            left = spark.read.format("statestore").option("stateVarName", "incident").load(state)
            return spark.read.schema(so.INCIDENT).parquet(path + "-out"), left.count()

    heads.write.parquet(path)
    some, open_now = run()
    assert 0 < open_now <= 4  # one incident per host and signal at most: the earlier ones have left
    early = some.count()
    heads.limit(0).unionByName(end, allowMissingColumns=True).write.mode("append").parquet(path)
    incidents, open_now = run()
    assert open_now == 0 and incidents.count() >= early
    decided = so.attach_repeats(spark.createDataFrame(rows, EVENT), incidents).collect()
    assert {r.case_id: (r.opened_by, r.decision) for r in decided} == plain_decisions(rows)


def test_minutes_in_any_order_open_the_same_incidents(spark):
    rows = events_of(2, 120)
    heads = rn.run_append(so.minute_heads(stream(spark, rows)), "heads", so.open_heads).orderBy(F.desc("minute")).collect()
    path = work_path(spark, "minutes")
    for k in range(3):  # all in one batch, newest file first
        spark.createDataFrame(heads[k::3], so.HEAD).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([(None, None, dt.datetime(2260, 1, 1), None)], so.HEAD).write.mode("append").parquet(path)
    with rn.stores_on_disk(spark):
        incidents = rn.run_append(so.incident_chain(spark.readStream.schema(so.HEAD).parquet(path)), "incidents")
    decided = so.attach_repeats(spark.createDataFrame(rows, EVENT), incidents).collect()
    assert {r.case_id: (r.opened_by, r.decision) for r in decided} == plain_decisions(rows)


def test_open_tails_come_out(spark):
    rows = events_of(3, 150)
    storms = rn.run_append(so.storm_sessions(stream(spark, rows)), "storms", so.open_storms)
    assert storms.agg(F.sum("size")).first()[0] == len(rows)
    last = max(r[1] for r in rows)
    assert storms.where(F.col("first_us") + F.col("duration_us") > F.lit(int((last - dt.timedelta(hours=1) - dt.datetime(1970, 1, 1)).total_seconds() * 10**6))).count() > 0
    rates = rn.run_append(so.sliding_rate(stream(spark, rows)), "rates", so.open_rates)
    assert rates.agg(F.sum("n")).first()[0] == 6 * len(rows)
    assert rates.count() == rates.select("host", "window_start").distinct().count()


def test_no_events(spark):
    empty = rn.run_append(so.storm_sessions(stream(spark, [])), "storms", so.open_storms)
    assert empty.count() == 0 and empty.columns == ["host", "signal", "first_us", "size", "duration_us"]


def test_incident_chain_of_many_keys_at_once_against_one_by_one():
    """All hosts and signals of a bucket, some without a signal, some with an incident of before, as each would be alone."""
    rng = random.Random(11)
    day = 24 * 60
    keys = [(f"h{i}", s) for i in range(40) for s in ("error", "view", None)]
    held = [(h, s, m * so.MINUTE, i, 1, 1) for i, ((h, s), m) in enumerate((k, m) for k in keys for m in sorted(rng.sample(range(30 * day), rng.randrange(1, 25))))]
    before = {k: rng.randrange(3 * day) * so.MINUTE for k in keys[::3]}
    want = []
    for k in keys:
        opened = before.get(k)
        for row in held:
            if row[:2] == k and (opened is None or row[2] > opened + so.INCIDENT_MICROS):
                opened = row[2]
                want.append(row[3])
    rng.shuffle(held)
    frame = pd.DataFrame(held, columns=so.HELD).sort_values(["host", "signal", "minute"], ignore_index=True)
    known = pd.DataFrame([(*k, v) for k, v in before.items()], columns=["host", "signal", "opened"])
    assert sorted(so._chain(frame, known)["case_id"]) == sorted(want)
