"""Queries of the streaming twins, over the events read as a stream of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import tables as tb
from ..sources.keyed import KeyedTable
from ..streaming import live
from . import sqlbase as q
from .registry import query


PARTS, LATE = 4, 10 * 24 * q.HOUR  # every seventh row comes ten days late


def _events(spark, sf):
    """Events with when they came: disordered, and some too late for their window."""
    return tb.load(spark, sf, "events").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value", F.col("ts").cast("timestamp").alias("ts"), tb.micros("ts").alias("t"),
        (F.col("value") / 10 - 60).alias("db")).withColumn("come", F.col("t") + F.when(F.col("id") % 7 == 0, LATE).otherwise(0))


# The same rows with their part and, per part, the watermark that the parts before it have left.
_CAME = f"""{q.EV}, come AS (SELECT *, t + CASE WHEN id % 7 = 0 THEN {LATE} ELSE 0 END AS come FROM ev),
 part AS (SELECT *, (come - min(come) OVER ()) * {PARTS} // (max(come) OVER () - min(come) OVER () + 1) AS part FROM come),
 top AS (SELECT part, max(max(t)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM part GROUP BY part),
 met AS (SELECT part.*, coalesce((before - 600000000) // 1000 * 1000, 0) AS mark FROM part JOIN top USING (part))"""


def _out(df):
    us = [F.unix_micros(c).alias(f"{c}_us") if c in ("start", "end") else F.col(c) for c in df.columns]
    return df.select(*us)


_MAX = "(SELECT max(t) FROM ev)"


def _levels(size: int) -> str:
    return f"""SELECT kind, start_us, start_us + {size * q.HOUR} AS end_us, round(10 * log10(avg(pow(10, (value / 10 - 60) / 10))), 6) AS level, max(value / 10 - 60) AS peak, count(*) AS n
 FROM w WHERE start_us + {size * q.HOUR} > mark GROUP BY kind, start_us HAVING start_us + {size * q.HOUR} <= ({_MAX} - 600000000) // 1000 * 1000"""


@query("st_tumbling_levels", f"WITH {_CAME}, w AS (SELECT *, t // {q.HOUR} * {q.HOUR} AS start_us FROM met) {_levels(1)}")
def st_tumbling_levels(spark, sf):
    drained = live.replayed(_events(spark, sf), "come", PARTS, lambda ev, out: live.run(live.levels(ev, "kind", "ts", "db", "10 minutes", "1 hour"), out))
    return _out(drained).withColumn("level", F.round("level", 6))


@query("st_sliding_levels", f"WITH {_CAME}, w AS (SELECT *, (t // {q.HOUR} - unnest([0, 1, 2])) * {q.HOUR} AS start_us FROM met) {_levels(3)}")
def st_sliding_levels(spark, sf):
    drained = live.replayed(_events(spark, sf), "come", PARTS, lambda ev, out: live.run(live.levels(ev, "kind", "ts", "db", "10 minutes", "3 hours", "1 hour"), out))
    return _out(drained).withColumn("level", F.round("level", 6))


@query("st_sessions", f"""WITH {q.EV}, l AS (SELECT *, lag(t) OVER (PARTITION BY key ORDER BY t, id) AS pt FROM ev), g AS (SELECT *, sum(CASE WHEN pt IS NULL OR t - pt >= {12 * q.HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY t, id) AS grp FROM l)
 SELECT key, min(t) AS start_us, max(t) + {12 * q.HOUR} AS end_us, count(*) AS n FROM g GROUP BY key, grp HAVING max(t) + {12 * q.HOUR} <= ({_MAX} - {12 * 24 * q.HOUR}) // 1000 * 1000""")
def st_sessions(spark, sf):
    """The watermark waits longer than rows come late, so none is lost and sittings grow over the parts."""
    return _out(live.replayed(_events(spark, sf), "come", PARTS, lambda ev, out: live.run(live.sessions(ev, "key", "ts", "12 days", "12 hours"), out)))


@query("st_dedupe", f"WITH {q.EV} SELECT DISTINCT key, kind FROM ev")
def st_dedupe(spark, sf):
    return live.replayed(_events(spark, sf), "come", PARTS, lambda ev, out: live.run(live.first_seen(ev, ["key", "kind"], "ts", "60 days"), out))


@query("st_upsert_sink", f"""WITH {q.EV} SELECT key, id, kind, value FROM ev QUALIFY row_number() OVER (PARTITION BY key ORDER BY t DESC, id DESC) = 1""")
def st_upsert_sink(spark, sf):
    table = KeyedTable(spark, shared_folder(spark, "table"), ["key"], ["t", "id"], buckets=16)
    rows = _events(spark, sf).select("key", "t", "id", "kind", "value", "come")
    return live.replayed(rows, "come", PARTS, lambda ev, out: live.upsert_stream(ev, table, out)).select("key", "id", "kind", "value")


_SHORT, _LONG = 12 * 3600 * 1000, 36 * 3600 * 1000


@query("st_heartbeat_abandoned", f"""WITH {q.EV}, l AS (SELECT key, max(t) AS last_us, arg_max(kind, t) = 'error' AS gone FROM ev GROUP BY key)
 SELECT key, last_us, CASE WHEN gone THEN 'worker gone' ELSE 'silent' END AS why FROM l WHERE last_us // 1000 + CASE WHEN gone THEN {_SHORT} ELSE {_LONG} END <= ({_MAX} - 600000000) // 1000""")
def st_heartbeat_abandoned(spark, sf):
    beats = _events(spark, sf).select("key", "ts", F.col("t").alias("us"), (F.col("kind") == "error").alias("gone"))
    with live.rocksdb_state(spark):
        return live.replayed(beats, "us", 1, lambda ev, out: live.run(live.abandoned(ev, "key", "ts", "10 minutes", _SHORT, _LONG), out))
