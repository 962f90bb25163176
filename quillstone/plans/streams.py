"""Queries that are streams over events: three arrivals, each caught up with by a stream that goes on from its checkpoint; some rows come an arrival late."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.sources import tables
from quillstone.streaming import audit as stream
from quillstone.streaming import state

from .catalog import query

#: The month is compressed to 7.2 hours, so that minutes have several rows; a ninth of the rows comes an arrival late.
_EVENTS = """e AS (SELECT event_id, user_id, event_type, value, us, make_timestamp(us) AS ts, least(2, (us - 1704067200000000) // 8640000000 + CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END) AS arrival
                   FROM (SELECT *, 1704067200000000 + (epoch_us(ts) - 1704067200000000) // 100 AS us FROM events)),
             ends AS (SELECT b, (SELECT max(us // 1000) FROM e WHERE arrival < b) - {late} * 60000 AS mark FROM range(0, 4) t(b))"""


def _arrivals(table):
    us = F.lit(1704067200000000) + F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 100)
    arrival = F.least(F.lit(2), F.floor((F.col("us") - 1704067200000000) / 8640000000) + F.when(F.col("event_id") % 9 == 0, 1).otherwise(0))
    return table("events").withColumn("us", us).withColumns({"ts": F.timestamp_micros("us"), "arrival": arrival})


def _in_turns(rows, name, make):
    """What the stream that make(stream) is gives for all arrivals of rows: for each its files are added, and the stream is run until it has caught up."""
    spark, base = rows.sparkSession, tables.fresh(rows.sparkSession, name)
    for b in range(3):
        rows.where(F.col("arrival") == b).drop("arrival").write.mode("append").parquet(f"{base}/in")
        state.caught_up(make(spark.readStream.schema(rows.drop("arrival").schema).parquet(f"{base}/in")), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out")


@query(f"""
    WITH {_EVENTS.format(late=30)}
    SELECT event_id AS id, event_type AS key, row_number() OVER (PARTITION BY event_type, us // 60000000 ORDER BY arrival, us, event_id) AS place, row_number() OVER (PARTITION BY event_type, us // 60000000 ORDER BY arrival, us, event_id) > 3 AS over
    FROM e JOIN ends ON arrival = b WHERE mark IS NULL OR us > mark * 1000
""")
def limit_stream(table):
    """Each request's place in its key's minute, given out as it arrives; those behind the watermark are dropped."""
    rows = _arrivals(table).select(F.col("event_id").alias("id"), F.col("event_type").alias("tenant_id"), "ts", "arrival")
    return _in_turns(rows, "limits", lambda s: state.limited(s, 3, late="30 minutes")).select("id", "key", "place", "over")


@query(f"""
    WITH {_EVENTS.format(late=5)},
         kept AS (SELECT user_id AS run_id, event_id AS id, us, arrival, floor(value * 100) AS cost, event_id % 13 = 0 AS reset FROM e JOIN ends ON arrival = b WHERE mark IS NULL OR us > mark * 1000),
         turns AS (SELECT run_id, arrival, max((us + 999) // 1000) AS last FROM kept GROUP BY ALL),
         due AS (SELECT *, max(last) OVER (PARTITION BY run_id ORDER BY arrival) + 60000 AS due, lead(arrival, 1, 3) OVER (PARTITION BY run_id ORDER BY arrival) AS upto FROM turns),
         shut AS (SELECT run_id, arrival, due <= mark AS closed FROM due JOIN ends ON upto = b),
         parts AS (SELECT kept.*, closed, (SELECT count(*) FROM shut s WHERE s.run_id = kept.run_id AND s.arrival < kept.arrival AND s.closed) AS life FROM kept JOIN shut USING (run_id, arrival)),
         cut AS (SELECT *, sum(CAST(reset AS INT)) OVER (PARTITION BY run_id, life ORDER BY arrival, us, id) AS part FROM parts),
         run AS (SELECT *, CAST(sum(cost) OVER w AS DOUBLE) AS running_cost, count(*) OVER w AS n_calls, row_number() OVER (PARTITION BY run_id, arrival ORDER BY us DESC, id DESC) AS from_end FROM cut WINDOW w AS (PARTITION BY run_id, life, part ORDER BY arrival, us, id ROWS UNBOUNDED PRECEDING))
    SELECT run_id, id, running_cost, n_calls, FALSE AS closed FROM run UNION ALL SELECT run_id, NULL, running_cost, n_calls, TRUE FROM run WHERE closed AND from_end = 1
""")
def cost_stream(table):
    """Running costs a run as calls arrive; runs that are idle are closed by timers and start anew if more calls come."""
    rows = _arrivals(table).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("id"), "ts", F.floor(F.col("value") * 100).cast("double").alias("cost"), (F.col("event_id") % 13 == 0).alias("reset"), "arrival")
    return _in_turns(rows, "costs", lambda s: state.running_costs(s, 1, late="5 minutes"))


@query(f"""
    WITH {_EVENTS.format(late=10)},
         w AS (SELECT event_type, us // 60000000 + 1 AS till, count(*) AS n FROM e JOIN ends ON arrival = b WHERE mark IS NULL OR (us // 60000000 + 1) * 60000 > mark GROUP BY ALL)
    SELECT event_type AS key, make_timestamp((till - 1) * 60000000) AS minute, n, greatest(n - 3, 0) AS n_over FROM w WHERE till * 60000 <= (SELECT mark FROM ends WHERE b = 3)
""")
def limit_window_stream(table):
    """Requests a key and minute, given out once the watermark has closed the minute."""
    rows = _arrivals(table).select(F.col("event_type").alias("key"), "ts", "arrival")
    return _in_turns(rows, "minutes", lambda s: stream.per_minute(s, 3, "key")).select("key", F.col("minute").cast("timestamp_ntz").alias("minute"), "n", "n_over")


@query(f"""
    WITH {_EVENTS.format(late=10)},
         w AS (SELECT us // 60000000 - k AS m, count(*) AS n, avg(CAST(event_type = 'error' AS INT)) AS rate FROM e JOIN ends ON arrival = b, range(0, 15) t(k) WHERE mark IS NULL OR (us // 60000000 - k + 15) * 60000 > mark GROUP BY ALL)
    SELECT make_timestamp(m * 60000000) AS start, n, round(rate, 9) AS rate FROM w WHERE (m + 15) * 60000 <= (SELECT mark FROM ends WHERE b = 3)
""")
def block_rate_stream(table):
    """The share of errors in sliding windows, given out as the watermark closes them."""
    rows = _arrivals(table).select("event_type", "ts", "arrival")
    return _in_turns(rows, "rates", lambda s: stream.block_rate(s, F.col("event_type") == "error")).select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("rate", 9).alias("rate"))
