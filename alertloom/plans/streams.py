"""Registered streaming queries. Each runs over the events table as a stream and has a batch twin in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom import fixtures as fx
from alertloom.operators import rubric as rb
from alertloom.plans.labeling import _LABEL, flat_label
from alertloom.session import cut_lineage, work_path
from alertloom.streaming import operators as so
from alertloom.streaming import runner as rn

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _host_signal(ev):
    return ev.select(F.col("event_id").alias("case_id"), "ts", F.col("user_id").cast("string").alias("host"), F.col("event_type").alias("signal"))


def _paged(ev):
    """First candidate's page decision on each event, NULL when it gave none."""
    e = F.col("event_id")
    p = F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.col("value") / 120.0 + (e % 7 - 3).cast("double") * 0.05))
    return ev.select("ts", (F.col("value") >= 60).alias("gold_page_now"), F.when((e * 7 + 3) % 53 > 2, p >= 0.5).alias("paged"))


@query("t1_stream_label", _LABEL + " SELECT * FROM label")
def t1_stream_label(spark, sf_dir):
    """The rubric on a stream: change and incident segments are static sides of stream joins."""
    stream = fx.shape_evidence(rn.read_event_stream(spark, sf_dir))
    return rn.run_append(flat_label(rb.label_tables(stream, fx.changes(spark, sf_dir), fx.incidents(spark, sf_dir), fx.ENTITY_COLUMNS)), "labels")


_BURDEN = """WITH c AS (SELECT epoch_ms(time_bucket(INTERVAL 1 HOUR, ts)) // 1000 AS window_start, value >= 60 AS gold,
  coalesce(CASE WHEN (event_id * 7 + 3) % 53 > 2 THEN least(0.999::DOUBLE, greatest(0.001::DOUBLE, value / 120.0::DOUBLE + (event_id % 7 - 3)::DOUBLE * 0.05::DOUBLE)) >= 0.5 END, false) AS paged FROM events),
b AS (SELECT window_start, count(*) AS events, count(*) FILTER (paged) AS pages, count(*) FILTER (paged AND NOT gold) AS false_pages, count(*) FILTER (NOT paged AND gold) AS missed FROM c GROUP BY 1)
SELECT *, round(1000.0::DOUBLE * pages / events, 6) AS pages_per_1k, round(1000.0::DOUBLE * false_pages / events, 6) AS false_per_1k FROM b"""


@query("t2_alert_burden", _BURDEN)
def t2_alert_burden(spark, sf_dir):
    burden = so.alert_burden(_paged(rn.read_event_stream(spark, sf_dir)))
    return so.burden_rates(rn.run_update(burden, ["window_start"], "burden"))


@query("t2_alert_burden_batch", _BURDEN)
def t2_alert_burden_batch(spark, sf_dir):
    return so.burden_rates(so.alert_burden(_paged(fx.events(spark, sf_dir))))


@query(
    "t3_storm_sessions",
    """WITH o AS (SELECT CAST(user_id AS VARCHAR) AS host, event_type AS signal, epoch_us(ts) AS us,
    CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 7200000000 THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)),
s AS (SELECT *, sum(starts) OVER (PARTITION BY host, signal ORDER BY us) AS sid FROM o)
SELECT host, signal, min(us) AS first_us, count(*) AS size, max(us) - min(us) AS duration_us FROM s GROUP BY host, signal, sid""",
)
def t3_storm_sessions(spark, sf_dir):
    return rn.run_append(so.storm_sessions(_host_signal(rn.read_event_stream(spark, sf_dir))), "storms", so.open_storms)


@query(
    "t4_sliding_rate",
    """WITH w AS (SELECT CAST(user_id AS VARCHAR) AS host, (epoch_us(ts) // 600000000 - k) * 600 AS window_start FROM events, range(6) r(k))
SELECT host, window_start, count(*) AS n FROM w GROUP BY ALL""",
)
def t4_sliding_rate(spark, sf_dir):
    return rn.run_append(so.sliding_rate(_host_signal(rn.read_event_stream(spark, sf_dir))), "rates", so.open_rates)


def _graded(ev):
    shaped = fx.shape_evidence(ev)
    ranks = rb.impact_rank(F.col("impact")).cast("int").alias("impact_rank"), rb.urgency_rank(F.col("urgency")).cast("int").alias("urgency_rank")
    return shaped.select(F.col("case_id"), "ts", "host", "signal", *ranks)


@query(
    "t5_repeat_attach",
    fx.sql_with("evidence").replace("WITH ", "WITH RECURSIVE ", 1) + """, e AS (SELECT case_id, ts, host, signal, epoch_us(ts) // 60000000 * 60 AS minute,
    list_position(['none', 'low', 'moderate', 'high'], impact)::INT AS impact_rank, list_position(['none', 'deferred', 'same_day', 'immediate'], urgency)::INT AS urgency_rank FROM evidence),
k0 AS (SELECT host, signal, minute, arg_min((case_id, impact_rank, urgency_rank), (ts, case_id)) AS first FROM e GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY host, signal ORDER BY minute) AS r FROM k0),
chain AS (SELECT host, signal, minute, r, minute AS opened, first FROM k WHERE r = 1
  UNION ALL SELECT k.host, k.signal, k.minute, k.r, CASE WHEN k.minute > c.opened + 172800 THEN k.minute ELSE c.opened END,
    CASE WHEN k.minute > c.opened + 172800 THEN k.first ELSE c.first END
  FROM chain c JOIN k ON k.host = c.host AND k.signal = c.signal AND k.r = c.r + 1)
SELECT e.case_id, host, signal, first[1] AS opened_by,
  CASE WHEN first[1] = e.case_id THEN 'opened' WHEN impact_rank <= first[2] AND urgency_rank <= first[3] THEN 'attached' ELSE 'reassessed' END AS decision
FROM e JOIN chain USING (host, signal, minute)""",
)
def t5_repeat_attach(spark, sf_dir):
    """Three steps: the first event of each minute, the chain of incidents they open, and a decision for every event."""
    ev = _graded(rn.read_event_stream(spark, sf_dir))
    heads = cut_lineage(rn.run_append(so.minute_heads(ev), "heads", so.open_heads))
    end = spark.range(1).select(F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("signal"), F.lit(so.END).cast("timestamp").alias("minute"))
    # The closing run: a last row, of no host, after which every minute is past and every incident over.
    path = work_path(spark, "minutes")
    heads.unionByName(end, allowMissingColumns=True).write.parquet(path)
    with rn.stores_on_disk(spark):
        buckets = -(-heads.count() // so.BUCKET_ROWS) + 1
        incidents = rn.run_append(so.incident_chain(spark.readStream.schema(so.HEAD).parquet(path), buckets), "incidents")
    return so.attach_repeats(_graded(fx.events(spark, sf_dir)), incidents).select("case_id", "host", "signal", "opened_by", "decision")


@query("t6_dedup", "SELECT event_id AS case_id, event_type AS signal FROM events")
def t6_dedup(spark, sf_dir):
    """Every event delivered twice; each id survives once."""
    s = _host_signal(rn.read_event_stream(spark, sf_dir))
    again = _host_signal(rn.read_event_stream(spark, sf_dir))
    return rn.run_append(so.deduplicate(s.union(again)), "dedup").select("case_id", "signal")


@query(
    "t7_late_data",
    """WITH mark AS (SELECT epoch_ms(max(ts)) - 3600000 AS ms FROM events WHERE event_id % 10 <> 0),
e AS (SELECT epoch_us(ts) // 3600000000 * 3600 AS window_start, event_id % 10 = 0 AS held FROM events)
SELECT window_start, count(*) AS n_batch, count(*) FILTER (NOT held OR (window_start + 3600) * 1000 > ms) AS n_stream,
  count(*) FILTER (held AND (window_start + 3600) * 1000 <= ms) AS n_late FROM e, mark GROUP BY 1""",
)
def t7_late_data(spark, sf_dir):
    """A tenth of the events arrives after all others; those behind the watermark are counted apart."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    held = F.col("event_id") % 10 == 0
    first, second = work_path(spark, "arrivals"), work_path(spark, "arrivals")
    ev.where(~held).write.parquet(first)
    ev.where(held).write.parquet(second)
    schema = ev.schema

    def window_counts(df):
        g = df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", so.DELAY).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
        return g.select(F.unix_timestamp("w.start").alias("window_start"), "n")

    counted = rn.run_arrivals(spark, schema, [first, second], window_counts, ["window_start"], "late")
    batch = window_counts(ev).withColumnRenamed("n", "n_batch")
    j = batch.join(counted.withColumnRenamed("n", "n_stream"), "window_start", "left").na.fill(0, ["n_stream"])
    return j.withColumn("n_late", F.col("n_batch") - F.col("n_stream"))
