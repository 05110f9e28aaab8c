"""Queries of the sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ordered import by_width, row_number
from ..session import shared_folder
from ..sources import files, logs, sinks
from ..sources import tables as tb
from ..sources.keyed import KeyedTable
from . import sqlbase as q
from .registry import query


_SEC = f"(t - {q.EPOCH}) / 1000000.0::DOUBLE"


@query("src_flatten_analysis", f"""WITH {q.EV}, d AS (SELECT *, key || '/' || t // {24 * q.HOUR} AS asset, t // {24 * q.HOUR} % 4 AS turn, {_SEC} AS sec FROM ev),
 seg AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY t, id) - 1 AS seg FROM d WHERE kind = 'click'),
 has AS (SELECT asset, any_value(turn) AS turn, count(*) FILTER (kind = 'error') AS black, count(*) FILTER (kind = 'purchase') AS quiet FROM d GROUP BY asset)
 SELECT 'black' AS part, asset, NULL::INT AS seg, NULL::INT AS idx, sec AS start, sec + value AS "end", NULL AS text FROM d WHERE kind = 'error'
 UNION ALL SELECT 'silence', asset, NULL, NULL, sec, sec + value, NULL FROM d WHERE kind = 'purchase' AND turn > 1
 UNION ALL SELECT 'word', asset, seg::INT, i::INT, sec + i, sec + i + 1, CASE WHEN i = 0 THEN kind ELSE id::VARCHAR END FROM seg, range(2) r(i)
 UNION ALL SELECT 'state', asset, NULL, NULL, NULL, NULL, 'black_frames ' || CASE WHEN black = 0 THEN 'empty' ELSE 'filled' END FROM has
 UNION ALL SELECT 'state', asset, NULL, NULL, NULL, NULL, 'silences ' || CASE turn WHEN 0 THEN 'absent' WHEN 1 THEN 'null' ELSE CASE WHEN quiet = 0 THEN 'empty' ELSE 'filled' END END FROM has""")
def src_flatten_analysis(spark, sf):
    """A user's day as one nested document kept as text: spans and a transcript with words; some documents lack silences, in some they are null."""
    ev = tb.events(spark, sf).withColumn("asset_id", F.concat_ws("/", "key", F.expr(f"t div {tb.DAY}"))).withColumn("at", F.expr(f"(t - {q.EPOCH}) / 1000000.0D"))

    def gathered(kind, *fields):  # a day's events at most
        row = F.when(F.col("kind") == kind, F.struct("t", "id", F.struct(*fields).alias("x")))
        return F.transform(F.array_sort(F.collect_list(row)), lambda r: r["x"])
    span = F.col("at").alias("start"), (F.col("at") + F.col("value")).alias("end")
    words = F.array(*[F.struct((F.col("at") + i).alias("start"), (F.col("at") + i + 1).alias("end"), F.col(c).cast("string").alias("text")) for i, c in enumerate(("kind", "id"))])
    docs = ev.groupBy("asset_id", F.expr(f"t div {tb.DAY} % 4").alias("turn")).agg(
        gathered("error", *span).alias("black_frames"), gathered("purchase", *span).alias("silences"), gathered("click", *span, words.alias("words")).alias("segments"))
    told = F.to_json(F.struct("asset_id", "black_frames", F.when(F.col("turn") > 1, F.col("silences")).alias("silences"), F.struct("segments").alias("transcript")))
    texts = docs.select(F.when(F.col("turn") == 1, F.concat(F.lit('{"silences":null,'), F.substring(told, F.lit(2), F.length(told)))).otherwise(told).alias("data"))
    parts = logs.flatten_analyses(logs.parse_analyses(texts, "data"))
    none = F.lit(None).cast("int")
    spans = parts["spans"].select(F.col("kind").alias("part"), F.col("key").alias("asset"), none.alias("seg"), none.alias("idx"), "start", "end", F.lit(None).cast("string").alias("text"))
    said = parts["words"].select(F.lit("word").alias("part"), F.col("key").alias("asset"), "seg", "idx", "start", "end", "text")
    states = logs.part_states(texts, "data", ["black_frames", "silences"]).select(
        F.lit("state").alias("part"), F.col("key").alias("asset"), none.alias("seg"), none.alias("idx"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"),
        F.concat_ws(" ", "part", "state").alias("text"))
    return spans.unionByName(said).unionByName(states)


@query("src_event_log_pairs", f"""WITH {q.EV}, m AS (SELECT *, lead(kind) OVER w AS nk, lead(t) OVER w AS nt FROM ev
 WHERE kind IN ('signup', 'error') WINDOW w AS (PARTITION BY key ORDER BY t, id)), d AS (SELECT key, max(t) AS fin FROM ev GROUP BY key)
 SELECT m.key, t AS s, coalesce(nt, fin) AS e FROM m JOIN d ON m.key = d.key
 WHERE kind = 'signup' AND (nk IS NULL OR nk = 'error') AND coalesce(nt, fin) > t""")
def src_event_log_pairs(spark, sf):
    ev = tb.events(spark, sf)
    fin = ev.groupBy("key").agg(F.max("t").alias("fin"))
    return logs.pair_events(ev, ["key"], ["t", "id"], by_width("t", tb.CHUNK), "kind", "t", "signup", "error", fin)


@query("src_frame_records", f"""WITH {q.EV} SELECT key, row_number() OVER (PARTITION BY key ORDER BY t, id) AS rec,
 t / 1000000.0::DOUBLE AS seconds, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, CAST(NULL AS DOUBLE) AS blur FROM ev""")
def src_frame_records(spark, sf):
    ev = tb.events(spark, sf)
    # The events as a detector would have logged them: a header line and the values under it.
    lines = F.array(
        F.concat(F.lit("frame:0 pts:0 pts_time:"), F.format_string("%d.%06d", F.expr("t div 1000000"), F.expr("t % 1000000"))),
        F.concat(F.lit("value="), F.col("value").cast("string")),
        F.concat(F.lit("k="), F.get_json_object("props", "$.k")), F.lit("blur=nan"), F.lit("level=-inf"))
    log = ev.select("key", "t", "id", F.posexplode(lines).alias("i", "line")).withColumn(
        "place", F.col("t") * 8 + F.col("i"))
    rec = logs.frame_records(log, ["key"], ["place", "id"], by_width("place", 8 * tb.CHUNK))
    v = F.col("values")
    return rec.select("key", "rec", "seconds", v["value"].alias("value"), v["k"].alias("k"), v["blur"].alias("blur"))


@query("src_import_listing")
def src_import_listing(spark, sf):
    return files.listing(spark, sf, "*.parquet").select("name", "bytes", "modificationTime")


@query("agg_usage")
def agg_usage(spark, sf):
    return files.usage(files.listing(spark, sf), [
        (r"/(events|conversations)\.parquet$", "streams", True), (r"/(embeddings)\.parquet$", "vectors", True),
        (r"\.parquet$", "tables", False)])


_TAGGED = """f AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN '1970-01-01T00:00:00' WHEN 'O'
  THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS tag,
 CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'VID_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '.mp4'
  WHEN o_orderpriority = '5-LOW' THEN 'clip 2020-13-45 10-00-00.mov' ELSE 'untitled.mov' END AS name FROM orders)"""


@query("src_recorded_at", f"""WITH {_TAGGED} SELECT id, coalesce(CASE WHEN year(CAST(tag AS TIMESTAMP)) > 2000 THEN CAST(tag AS TIMESTAMP) END,
 CASE WHEN name LIKE 'VID_2%' THEN try_strptime(substr(name, 5, 15), '%Y%m%d_%H%M%S') END) AS recorded_at FROM f""")
def src_recorded_at(spark, sf):
    o = tb.load(spark, sf, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    tag = F.when(F.col("o_orderstatus") == "F", "1970-01-01T00:00:00").when(
        F.col("o_orderstatus") == "O", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))
    name = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"),
                  F.concat(F.lit("VID_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(".mp4"))).when(
        F.col("o_orderpriority") == "5-LOW", "clip 2020-13-45 10-00-00.mov").otherwise("untitled.mov")
    named = o.select(F.col("o_orderkey").alias("id"), tag.alias("tag"), name.alias("name"))
    return named.select("id", files.recorded_at(F.col("tag"), F.col("name")).cast("timestamp_ntz").alias("recorded_at"))


@query("sink_upsert_latest", f"""WITH {q.EV} SELECT key, id, kind, value FROM ev
 QUALIFY row_number() OVER (PARTITION BY key ORDER BY t DESC, id DESC) = 1""")
def sink_upsert_latest(spark, sf):
    """The events merged into a keyed table in two batches, and read back from its files."""
    ev = tb.events(spark, sf).select("key", "t", "id", "kind", "value")
    table = KeyedTable(spark, shared_folder(spark, "table"), ["key"], ["t", "id"], buckets=16)
    table.merge(ev.where("id % 3 <> 0"), 0)
    table.merge(ev.where("id % 3 = 0"), 1)
    return table.read().select("key", "id", "kind", "value")


@query("sink_append_versions", """SELECT o_custkey AS key, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS version,
 arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, count(*) AS versions FROM orders GROUP BY o_custkey""")
def sink_append_versions(spark, sf):
    o = tb.load(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version"),
                                            F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("at"))
    log = shared_folder(spark, "versions")
    for status in ("O", "F", "P"):  # three appends, in no order of time
        sinks.append_versions(log, o.where(F.col("status") == status))
    return sinks.current(spark.read.parquet(log), ["key"], ["at", "version"]).select("key", "version", "status", "versions")


@query("sink_timed_text", f"""WITH {q.TURNS}, m AS (SELECT key, turn, (s + 500) // 1000 AS a, (e + 500) // 1000 AS b, text,
 row_number() OVER (PARTITION BY key ORDER BY turn) AS n FROM turns)
 SELECT key, n, CAST(n AS VARCHAR) || chr(10) || format('{{:02d}}:{{:02d}}:{{:02d}},{{:03d}} --> {{:02d}}:{{:02d}}:{{:02d}},{{:03d}}',
 a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000, b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000)
 || chr(10) || text || chr(10) AS block FROM m""")
def sink_timed_text(spark, sf):
    cues = tb.turns(spark, sf, n=row_number())
    folder = shared_folder(spark, "captions")
    sinks.write_srt(sinks.srt_blocks(cues), folder, "key")
    return sinks.read_srt(spark, folder, "key", "long").select("key", "n", "block")


_MARKS = """tot AS (SELECT key, max(tle) AS total FROM pl GROUP BY key), mk AS (SELECT pl.key, id, kind, tl, total FROM pl JOIN tot ON pl.key = tot.key
 WHERE kind = 'signup' AND tl < total), ch AS (SELECT key, CAST(id AS VARCHAR) AS name, tl AS s,
 coalesce(lead(tl) OVER (PARTITION BY key ORDER BY tl, id), total) AS e FROM mk)"""


@query("sink_chapters", f"""WITH {q.PLACED}, {_MARKS}, per AS (SELECT tot.key, count(ch.s) AS n, min(ch.s) AS f FROM tot LEFT JOIN ch ON tot.key = ch.key GROUP BY tot.key)
 SELECT key, 'chapter' AS row, name, s, e FROM ch UNION ALL SELECT key, 'short', name, s, e FROM ch WHERE e - s < {6 * q.HOUR}
 UNION ALL SELECT key, 'none', NULL, n, NULL FROM per WHERE n = 0 UNION ALL SELECT key, 'first', NULL, f, NULL FROM per WHERE f > 0
 UNION ALL SELECT key, 'few', NULL, n, NULL FROM per WHERE n > 0 AND n < 12""")
def sink_chapters(spark, sf):
    pl = tb.placements(spark, sf)
    totals = pl.groupBy("key").agg(F.max("tle").alias("total"))
    marks = pl.where(F.col("kind") == "signup").select("key", "id", "tl", F.col("id").cast("string").alias("name"))
    listed = sinks.chapters(marks, totals, "key", "tl", "name", "id", by_width("tl", tb.CHUNK))
    rows = listed.select("key", F.lit("chapter").alias("row"), "name", "s", "e")
    short = listed.where(F.col("e") - F.col("s") < 6 * tb.HOUR).select("key", F.lit("short").alias("row"), "name", "s", "e")
    whole = sinks.chapter_problems(listed, totals.select("key"), "key", 12, 0)
    return rows.unionByName(short).unionByName(whole.select(
        "key", F.col("problem").alias("row"), F.lit(None).cast("string").alias("name"),
        F.col("figure").alias("s"), F.lit(None).cast("long").alias("e")))
