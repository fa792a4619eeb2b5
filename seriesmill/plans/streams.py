"""Queries of streaming jobs, run over the events that are there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import jobs
from .inputs import finish, query, r, rounded, table


def stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return jobs.source(spark, f"{sf_dir}/events.parquet", schema).withColumn("at", F.col("ts").cast("timestamp"))


_TOP = "(SELECT max(epoch_us(ts)) // 1000000 * 1000000 - 3600000000 FROM events)"


def closed(df, sf_dir, spark):
    """Windows that ended an hour before the last event, which is when the watermark has surely passed them."""
    top = table(spark, sf_dir, "events").agg(F.expr("unix_micros(cast(max(ts) as timestamp)) div 1000000 * 1000000")).first()[0]
    return df.where(F.unix_micros("end") <= F.lit((top or 0) - 3_600_000_000))


@query("stream_bars", f"""
WITH w AS (SELECT event_type, epoch_us(ts) // 21600000000 AS w, value, ts, event_id, user_id FROM events)
SELECT event_type, w * 21600 AS start, {rounded({'open': 'first(value ORDER BY ts, event_id)', 'high': 'max(value)', 'low': 'min(value)', 'close': 'last(value ORDER BY ts, event_id)', 'volume': 'sum(1 + user_id % 10)::DOUBLE'})} FROM w WHERE (w + 1) * 21600000000 <= {_TOP} GROUP BY event_type, w""")
def stream_bars(spark, sf_dir):
    """Six-hour bars of the event stream."""
    out = jobs.bars(stream(spark, sf_dir), ["event_type"], "at", "event_id", "value", "6 hours", volume=(1 + F.col("user_id") % 10).cast("double"))
    done = closed(jobs.run_available(out, "stream-bars", spark), sf_dir, spark)
    return finish(done.withColumn("start", F.unix_seconds("start")), "event_type", "start", "open", "high", "low", "close", "volume")


@query("stream_sliding", f"""
WITH w AS (SELECT event_type, value, unnest([epoch_us(ts) // 3600000000 - 1, epoch_us(ts) // 3600000000]) AS w FROM events)
SELECT event_type, w * 3600 AS start, {r('max(value)')} AS high, {r('min(value)')} AS low, count(*)::DOUBLE AS volume FROM w WHERE (w + 2) * 3600000000 <= {_TOP} GROUP BY event_type, w""")
def stream_sliding(spark, sf_dir):
    """Two-hour windows every hour."""
    out = jobs.bars(stream(spark, sf_dir), ["event_type"], "at", "event_id", "value", "2 hours", "1 hour")
    done = closed(jobs.run_available(out, "stream-sliding", spark), sf_dir, spark)
    return finish(done.withColumn("start", F.unix_seconds("start")), "event_type", "start", "high", "low", "volume")


@query("stream_sessions", f"""
WITH g AS (SELECT event_type, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS n FROM events),
s AS (SELECT event_type, t, sum(n) OVER (PARTITION BY event_type ORDER BY t) AS k FROM g), z AS (SELECT event_type, k, min(t) AS lo, max(t) + 1800000000 AS hi, count(*) AS events FROM s GROUP BY 1, 2)
SELECT event_type, lo AS start, events FROM z WHERE hi <= {_TOP}""")
def stream_sessions(spark, sf_dir):
    """Bursts of one type with gaps under half an hour."""
    out = jobs.sessions(stream(spark, sf_dir), ["event_type"], "at", "30 minutes")
    done = closed(jobs.run_available(out, "stream-sessions", spark), sf_dir, spark)
    return done.select("event_type", F.unix_micros("start").alias("start"), "events")


@query("stream_dedup", "SELECT DISTINCT user_id, epoch_us(ts) // 60000000 AS minute FROM events")
def stream_dedup(spark, sf_dir):
    """One event for each user and minute."""
    s = stream(spark, sf_dir).withColumn("minute", F.expr("unix_micros(at) div 60000000"))
    return jobs.run_available(jobs.deduplicate(s, ["user_id", "minute"], "at").select("user_id", "minute"), "stream-dedup", spark)


@query("stream_ema", f"""
WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) - 1 AS back, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, any_value(n) AS rows, {r(f'sum(value * pow({1 - 2 / 21}, back) * (CASE WHEN back = n - 1 THEN 1 ELSE {2 / 21} END))')} AS ema FROM n GROUP BY event_type""")
def stream_ema(spark, sf_dir):
    """Exponential average of each type, kept as state."""
    out = jobs.ema(stream(spark, sf_dir).select("event_type", "at", "value"), ["event_type"], "at", "value")
    got = jobs.run_available(out, "stream-ema", spark)
    last = got.groupBy("event_type").agg(F.max("rows").alias("rows"), F.max_by("ema", "rows").alias("ema"))
    return finish(last)


@query("stream_latch", """
WITH e AS (SELECT event_type, ts, event_id, CASE WHEN value >= 150 THEN 1 WHEN value <= 20 THEN 0 END AS e FROM events), l AS (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS s FROM e),
c AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY event_type ORDER BY ts), 0) AS b FROM l) SELECT event_type, epoch_us(ts) AS at, s::INTEGER AS state FROM c WHERE s <> b""")
def stream_latch(spark, sf_dir):
    """Changes of a latch with hysteresis."""
    out = jobs.hysteresis(stream(spark, sf_dir).select("event_type", "at", "value"), ["event_type"], "at", "value", 150, 20)
    return jobs.run_available(out, "stream-latch", spark).withColumn("at", F.unix_micros("at"))
