"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import rollup as ru
from ..operators.ordered import by_width, exact_quantiles, nxt, ordered_scan, rank_picks, row_number, spread_join
from ..session import cut_lineage
from ..sources import tables as tb
from . import sqlbase as q
from .registry import query

_PAIRS = "pr AS (SELECT a.key, id, bid, bvalue AS v, bvalue / 10 - 60 AS db, least(e, be) - greatest(s, bs) AS w FROM a JOIN b ON a.key = b.key AND s < be AND bs < e)"


def _pairs(spark, sf):
    p = iv.overlap_join(tb.spans_a(spark, sf).select("key", "id", "s", "e"), tb.spans_b(spark, sf), ["key"], ("s", "e"), ("bs", "be"), tb.BIN)
    return p.select("key", "id", "bid", F.col("bvalue").alias("v"), (F.col("bvalue") / 10 - 60).alias("db"),
                    iv.overlap_length("s", "e", "bs", "be").alias("w"))


@query("agg_weighted_mean", f"WITH {q.AB}, {_PAIRS} SELECT key, id, round(sum(v * w) / sum(w), 4) AS mean FROM pr GROUP BY key, id")
def agg_weighted_mean(spark, sf):
    return _pairs(spark, sf).groupBy("key", "id").agg(F.round(ru.weighted_mean(F.col("v"), F.col("w")), 4).alias("mean"))


@query("agg_energy_mean", f"WITH {q.AB}, {_PAIRS} SELECT key, id, round(greatest(-120, 10 * log10(sum(pow(10, db / 10) * w) / sum(w))), 4) AS level FROM pr GROUP BY key, id")
def agg_energy_mean(spark, sf):
    return _pairs(spark, sf).groupBy("key", "id").agg(F.round(ru.energy_mean(F.col("db"), F.col("w")), 4).alias("level"))


@query("agg_weighted_median", f"""WITH {q.AB}, {_PAIRS}, c AS (SELECT *, sum(w) OVER (PARTITION BY id ORDER BY v, w ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY id) AS t FROM pr)
 SELECT key, id, min(v) AS median FROM c WHERE 2 * c >= t GROUP BY key, id""")
def agg_weighted_median(spark, sf):
    return ru.weighted_median(_pairs(spark, sf), ["key", "id"], "v", "w", 10.0, "median")


@query("agg_peak", f"WITH {q.AB}, {_PAIRS} SELECT key, id, max(v) AS peak FROM pr GROUP BY key, id")
def agg_peak(spark, sf):
    return _pairs(spark, sf).groupBy("key", "id").agg(F.max("v").alias("peak"))


_HOURS = f"""ak AS (SELECT kind AS key, id, s, e FROM a), ser AS (SELECT kind AS key, (t - {q.EPOCH}) // {q.HOUR} AS sec, round(-20 - avg(value) / 9.7, 7) AS loudness, max(value) AS peak, count(*) AS n FROM ev GROUP BY 1, 2),
 hp AS (SELECT ak.key, id, sec, loudness, peak, n, least(e, {q.EPOCH} + (sec + 1) * {q.HOUR}) - greatest(s, {q.EPOCH} + sec * {q.HOUR}) AS w FROM ak JOIN ser ON ak.key = ser.key AND s < {q.EPOCH} + (sec + 1) * {q.HOUR} AND {q.EPOCH} + sec * {q.HOUR} < e)"""


def _hours(spark, sf):
    ser = tb.series(spark, sf).withColumn("hs", F.col("sec") * tb.HOUR + tb.EPOCH).withColumn("he", F.col("hs") + tb.HOUR)
    ak = tb.spans_a(spark, sf).select(F.col("kind").alias("key"), "id", "s", "e")
    p = iv.overlap_join(ak, ser, ["key"], ("s", "e"), ("hs", "he"), tb.BIN)
    return p.withColumn("w", iv.overlap_length("s", "e", "hs", "he"))


@query("agg_score_rollup", f"""WITH {q.A}, {_HOURS}, md AS (SELECT *, sum(w) OVER (PARTITION BY id ORDER BY loudness, w, sec ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY id) AS t FROM hp)
 SELECT id, 'loudness' AS name, round(greatest(-120, 10 * log10(sum(pow(10, loudness / 10) * w) / sum(w))), 2) AS value FROM hp GROUP BY id
 UNION ALL SELECT id, 'peak', max(peak) FROM hp GROUP BY id UNION ALL SELECT id, 'exposure', round(sum(n * w) / sum(w), 4) FROM hp GROUP BY id
 UNION ALL SELECT id, 'noise_floor', min(loudness) FROM md WHERE 2 * c >= t GROUP BY id""")
def agg_score_rollup(spark, sf):
    long = _hours(spark, sf).select("id", "w", F.expr(
        "stack(4, 'loudness', loudness, 'peak', peak, 'exposure', cast(n as double), 'noise_floor', loudness) as (name, v)"))
    return ru.combine_scores(long, ["id"], "name", "v", "w", {**ru.SCORE_RULES, "noise_floor": ru.Rule("median", 7)})


@query("agg_content_spread", f"""WITH {q.CLIPS} SELECT key, 'quality' AS name, round(sum(quality * (e - s)) / sum(e - s), 4) AS value FROM clips GROUP BY key HAVING count(quality) > 0
 UNION ALL SELECT key, 'toxic', round(sum(toxic * (e - s)) / sum(CASE WHEN toxic IS NOT NULL THEN e - s END), 4) FROM clips GROUP BY key HAVING count(toxic) > 0""")
def agg_content_spread(spark, sf):
    c = tb.clips(spark, sf).withColumn("w", F.col("e") - F.col("s"))
    parts = c.select("key", "w", F.explode(F.map_filter("scores", lambda k, v: k != "length")).alias("name", "v"))
    rules = {"quality": ru.Rule(decimals=4, content=True), "toxic": ru.Rule(decimals=4)}
    return ru.combine_scores(parts, ["key"], "name", "v", "w", rules, c.groupBy("key").agg(F.sum("w").alias("whole")))


_DAY = 24 * q.HOUR


@query("agg_section_rollup", f"""WITH {q.A}, m AS (SELECT *, s // {_DAY} AS sec FROM a), k AS (SELECT key, sec, kind, sum(e - s) AS len, min(s) AS f FROM m GROUP BY 1, 2, 3)
 SELECT m.key, m.sec, min(s) AS s, max(e) AS e, arg_min(value, (s, id)) AS safe_in, arg_max(value, (s, id)) AS safe_out, count(*) AS n,
 CASE WHEN bool_or(m.kind = 'click') THEN 'click' ELSE any_value(top) END AS kind FROM m JOIN (SELECT key, sec, arg_max(kind, (len, -f)) AS top FROM k GROUP BY 1, 2) t ON m.key = t.key AND m.sec = t.sec GROUP BY m.key, m.sec""")
def agg_section_rollup(spark, sf):
    m = tb.spans_a(spark, sf).withColumn("sec", F.expr(f"s div {_DAY}"))
    at = F.struct("s", "id")
    # Rolled up by kind first, so one pass gives both the kinds' lengths and the section.
    k = m.groupBy("key", "sec", "kind").agg(
        F.sum(F.col("e") - F.col("s")).alias("len"), F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("n"),
        F.min(at).alias("f"), F.max(at).alias("l"), F.min_by("value", at).alias("fv"), F.max_by("value", at).alias("lv"))
    top = F.max_by("kind", F.struct("len", (-F.col("s")).alias("f")))
    return k.groupBy("key", "sec").agg(
        F.min("s").alias("s"), F.max("e").alias("e"), F.min_by("fv", "f").alias("safe_in"), F.max_by("lv", "l").alias("safe_out"),
        F.sum("n").alias("n"), F.when(F.bool_or(F.col("kind") == "click"), "click").otherwise(top).alias("kind"))


@query("agg_gated_mean", f"""WITH {q.EV}, x AS (SELECT key, value / 5 - 75 AS l FROM ev), g AS (SELECT key, avg(pow(10, l / 10)) * 0.1 AS f FROM x WHERE l > -70 GROUP BY key)
 SELECT k.key, round(10 * log10(avg(pow(10, l / 10)) FILTER (WHERE l > -70 AND pow(10, l / 10) > f)), 4) AS lufs FROM (SELECT DISTINCT key FROM x) k LEFT JOIN x ON k.key = x.key LEFT JOIN g ON k.key = g.key GROUP BY k.key""")
def agg_gated_mean(spark, sf):
    x = tb.events(spark, sf).select("key", (F.col("value") / 5 - 75).alias("l"))
    return ru.gated_mean(x, ["key"], "l").select("key", F.round("lufs", 4).alias("lufs"))


@query("agg_sound_note", """SELECT event_type AS key, count(*) AS windows, min(value) AS lowest, round(quantile_cont(value, 0.5), 6) AS median, max(value) AS highest FROM events GROUP BY 1""")
def agg_sound_note(spark, sf):
    ev = tb.events(spark, sf).select(F.col("kind").alias("key"), "value")
    mid = exact_quantiles(ev, ["key"], "value", {"median": 0.5}, 5.0)
    return ev.groupBy("key").agg(F.count(F.lit(1)).alias("windows"), F.min("value").alias("lowest"), F.max("value").alias("highest")).join(
        mid, "key").select("key", "windows", "lowest", F.round("median", 6).alias("median"), "highest")


_INSIDE = "ins AS (SELECT b.key, bid, ev.t, ev.id, ev.value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM b JOIN ev ON ev.key = b.key AND bs <= ev.t AND ev.t < be)"


def _inside(spark, sf):
    ev = tb.events(spark, sf).select("key", "id", "t", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return iv.point_join(ev, tb.spans_b(spark, sf).drop("bvalue"), ["key"], "t", ("bs", "be"), tb.BIN)


@query("agg_shot_fold", f"""WITH {q.B}, {_INSIDE} SELECT key, bid, round(avg(value) / 255, 4) AS exposure, CASE WHEN count(*) > 1 THEN round((sum(value) - arg_min(value, (t, id))) / (count(*) - 1) / 255, 4) END AS motion FROM ins GROUP BY key, bid""")
def agg_shot_fold(spark, sf):
    f = ru.fold_samples(_inside(spark, sf), ["key", "bid"], "value", F.struct("t", "id"))
    return f.select("key", "bid", F.round(F.col("mean") / 255, 4).alias("exposure"), F.round(F.col("moving") / 255, 4).alias("motion"))


@query("agg_jitter", f"""WITH {q.B}, {_INSIDE}, l AS (SELECT bid, sqrt(pow(value / 100 - lag(value / 100) OVER w, 2) + pow(k / 100 - lag(k / 100) OVER w, 2)) AS d, row_number() OVER w AS rn FROM ins WINDOW w AS (PARTITION BY bid ORDER BY t, id))
 SELECT bid, round(avg(CASE WHEN rn >= 3 THEN d END), 5) AS shake FROM l GROUP BY bid""")
def agg_jitter(spark, sf):
    m = _inside(spark, sf).select("bid", "t", "id", (F.col("value") / 100).alias("dx"), (F.col("k") / 100).alias("dy"))
    return ru.jitter(m, ["bid"], "dx", "dy", ["t", "id"], by_width("t", tb.CHUNK)).select("bid", F.round("shake", 5).alias("shake"))


@query("agg_per_second", f"""WITH {q.EV}, f AS (SELECT kind AS key, t // 60000000 AS frame, count(*) AS n, max((value, id)) AS big FROM ev GROUP BY 1, 2)
 SELECT key, frame // 60 AS second, max(n) AS faces, struct_extract(max(big), 1) AS face_share, struct_extract(max(big), 2) AS face_id FROM f GROUP BY 1, 2""")
def agg_per_second(spark, sf):
    f = tb.events(spark, sf).groupBy(F.col("kind").alias("key"), F.expr("t div 60000000").alias("frame")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("value", "id")).alias("big"))
    return f.groupBy("key", F.expr("frame div 60").alias("second")).agg(
        F.max("n").alias("faces"), F.max("big").alias("b")).select("key", "second", "faces", F.col("b.value").alias("face_share"), F.col("b.id").alias("face_id"))


@query("agg_presence_note", f"""WITH {q.EV}, r AS (SELECT key, t, id, CAST(json_extract(props, '$.k') AS DOUBLE) AS faces, CASE WHEN kind = 'click' THEN value END AS x FROM ev)
 SELECT key, count(*) AS seconds, round(avg(CASE WHEN x IS NOT NULL THEN 1.0 ELSE 0.0 END), 4) AS with_a_face, round(quantile_cont(faces, 0.5), 4) AS faces_median, round(quantile_cont(x, 0.5), 6) AS x_median, min(x) AS x_low, max(x) AS x_high, arg_max(t, (x, -t)) FILTER (WHERE x IS NOT NULL) AS largest_at FROM r GROUP BY key""")
def agg_presence_note(spark, sf):
    r = tb.events(spark, sf).select("key", "t", F.get_json_object("props", "$.k").cast("double").alias("faces"),
                                    F.when(F.col("kind") == "click", F.col("value")).alias("x"))
    base = r.groupBy("key").agg(
        F.count(F.lit(1)).alias("seconds"), F.round(F.avg(F.col("x").isNotNull().cast("double")), 4).alias("with_a_face"),
        F.min("x").alias("x_low"), F.max("x").alias("x_high"),
        F.max_by("t", F.when(F.col("x").isNotNull(), F.struct("x", (-F.col("t")).alias("t")))).alias("largest_at"))
    faces = exact_quantiles(r, ["key"], "faces", {"faces_median": 0.5}, 10.0)
    across = exact_quantiles(r, ["key"], "x", {"x_median": 0.5}, 10.0)
    return base.join(faces, "key").join(across, "key", "left").withColumn("faces_median", F.round("faces_median", 4)).withColumn(
        "x_median", F.round("x_median", 6))


@query("agg_counts", f"""WITH {q.CLIPS} SELECT key, level, kind, GROUPING(key, level, kind) AS summed, count(*) AS n FROM clips
 GROUP BY GROUPING SETS ((key, level, kind), (level, kind), (level), ())""")
def agg_counts(spark, sf):
    """The finest counts are made first, so the expanding pass over the sets of keys has few rows. ``summed`` tells a total from a null key."""
    fine = tb.clips(spark, sf).groupBy("key", "level", "kind").agg(F.count(F.lit(1)).alias("n"))
    sets = [["key", "level", "kind"], ["level", "kind"], ["level"], []]
    return fine.groupingSets([[F.col(c) for c in x] for x in sets], "key", "level", "kind").agg(F.grouping_id().alias("summed"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query("agg_version_counts", "SELECT CAST(o_custkey AS VARCHAR) AS id, count(*) AS versions FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def agg_version_counts(spark, sf):
    path = F.concat(F.when(F.col("o_orderstatus") == "F", "plans/").otherwise("projects/"), F.col("o_custkey").cast("string"), F.lit(".json"))
    log = tb.load(spark, sf, "orders").select(path.alias("path"))
    return log.where(F.col("path").startswith("projects/")).groupBy(
        F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("id")).agg(F.count(F.lit(1)).alias("versions"))


@query("agg_voice_seconds", f"WITH {q.TURNS}, v AS (SELECT speaker, CAST(sum(e - s) AS BIGINT) AS us FROM turns GROUP BY speaker) SELECT speaker, us, us < 0.1 * (SELECT sum(us) FROM v) AS minor FROM v")
def agg_voice_seconds(spark, sf):
    v = tb.turns(spark, sf).groupBy("speaker").agg(F.sum(F.col("e") - F.col("s")).alias("us"))
    # The total is one row.
    return v.crossJoin(F.broadcast(v.agg(F.sum("us").alias("all")))).select(
        "speaker", "us", (F.col("us") < 0.1 * F.col("all")).alias("minor")).orderBy(F.col("us").desc())


_PAUSE = f"""g AS (SELECT key, id, lead(t) OVER (PARTITION BY key ORDER BY t, id) - t - CAST(round(value * 60 * 1000000) AS BIGINT) AS gap FROM ev),
 u AS (SELECT * FROM g WHERE gap > 0 AND gap <= {12 * q.HOUR}), s AS (SELECT key, list_sort(list(gap)) AS l FROM u GROUP BY key HAVING count(*) >= 5)"""


@query("agg_pause_profile", f"""WITH {q.EV}, {_PAUSE} SELECT u.key, id, gap, l[len(l) // 4 + 1] AS low, l[3 * len(l) // 4 + 1] AS high,
 CASE WHEN gap < l[len(l) // 4 + 1] THEN 'shorter' WHEN gap > l[3 * len(l) // 4 + 1] THEN 'longer' ELSE 'within' END AS label FROM u JOIN s ON u.key = s.key""")
def agg_pause_profile(spark, sf):
    ev = ordered_scan(tb.events(spark, sf).drop("props", "kind"), ["key"], ["t", "id"], by_width("t", tb.CHUNK), {"__n": nxt(F.col("t"))})
    gap = F.col("__n") - F.col("t") - F.round(F.col("value") * 60 * tb.SECOND).cast("long")
    u = ev.select("key", "id", gap.alias("gap")).where((F.col("gap") > 0) & (F.col("gap") <= 12 * tb.HOUR))
    n = F.col("__total")
    usual = rank_picks(u, ["key"], "gap", {"low": F.floor(n / 4), "high": F.floor(3 * n / 4)}, float(tb.HOUR)).where(n >= 5)
    return spread_join(u, usual.drop("__total"), "key").select("key", "id", "gap", "low", "high", F.when(F.col("gap") < F.col("low"), "shorter").when(
        F.col("gap") > F.col("high"), "longer").otherwise("within").alias("label"))


@query("agg_level_by_part", f"""WITH {q.SERIES}, p AS (SELECT key, quantile_cont(loudness, 0.95) - 3 AS floor_ FROM series GROUP BY key),
 f AS (SELECT series.key, sec // 168 AS part, loudness, peak, loudness > floor_ AS talking FROM series JOIN p ON series.key = p.key)
 SELECT key, part, round(quantile_cont(loudness, 0.5) FILTER (WHERE talking), 6) AS voice, round(quantile_cont(peak, 0.5) FILTER (WHERE talking), 6) AS under, round(quantile_cont(peak, 0.5) FILTER (WHERE NOT talking), 6) AS alone FROM f GROUP BY 1, 2""")
def agg_level_by_part(spark, sf):
    s = tb.series(spark, sf)
    loud = exact_quantiles(s, ["key"], "loudness", {"p95": 0.95}, 1.0)
    f = spread_join(s, loud, "key").withColumn("part", F.expr("sec div 168")).withColumn("talking", F.col("loudness") > F.col("p95") - 3)
    f = f.select("key", "part", F.when(F.col("talking"), F.col("loudness")).alias("v"), F.when(F.col("talking"), F.col("peak")).alias("u"),
                 F.when(~F.col("talking"), F.col("peak")).alias("m"))
    # The three medians are one long table, so the values are ranked once.
    long = f.select("key", "part", F.expr("stack(3, 'voice', v, 'under', u, 'alone', m) as (what, x)"))
    mid = exact_quantiles(long, ["key", "part", "what"], "x", {"mid": 0.5}, 5.0)
    return mid.groupBy("key", "part").pivot("what", ["voice", "under", "alone"]).agg(F.round(F.first("mid"), 6))


@query("agg_gain_to_target", f"""WITH {q.A}, {_HOURS}, x AS (SELECT key, id, id IN (SELECT id FROM ev WHERE value > 100) AS kept, sum(CASE WHEN n >= 3 THEN 1 ELSE 0 END) AS k, avg(pow(10, loudness / 10)) FILTER (WHERE n >= 3) AS t, avg(pow(10, loudness / 10)) FILTER (WHERE loudness > -60) AS h FROM hp GROUP BY 1, 2),
 w AS (SELECT key, avg(pow(10, loudness / 10)) AS w FROM (SELECT DISTINCT key, sec, loudness FROM hp WHERE n >= 3) GROUP BY key),
 g AS (SELECT x.key, id, kept, round(greatest(-12, least(12, CASE WHEN k > 0 THEN -20 - 10 * log10(CASE WHEN k < 3 THEN w ELSE t END) ELSE least(0, -30 - 10 * log10(h)) END)), 2) AS gain FROM x LEFT JOIN w ON x.key = w.key),
 m AS (SELECT key, list_sort(list(gain))[count(*) // 2 + 1] AS mid FROM g WHERE NOT kept AND gain IS NOT NULL GROUP BY key)
 SELECT g.key, id, CASE WHEN kept THEN coalesce(mid, 0) ELSE gain END AS gain FROM g LEFT JOIN m ON g.key = m.key WHERE kept OR gain IS NOT NULL""")
def agg_gain_to_target(spark, sf):
    hours = _hours(spark, sf).select("key", "id", "sec", "loudness", (F.col("n") >= 3).alias("talk"))
    clips = tb.spans_a(spark, sf).select(F.col("kind").alias("key"), "id", (F.col("value") > 100).alias("kept"))
    return ru.talk_gains(clips, hours, "key", "id", "kept", "loudness", "talk")


@query("agg_stage_profile", f"""WITH {q.EV}, r AS (SELECT key AS job, kind || ' #' AS stage, value, CAST(json_extract(props, '$.k') AS BIGINT) AS m FROM ev),
 f AS (SELECT sum(sp) AS footage FROM (SELECT (max(t) - min(t)) / 1e6 AS sp FROM ev GROUP BY key))
 SELECT stage, count(DISTINCT job) AS jobs, round(sum(value), 3) AS total, round(sum(value) / (SELECT sum(value) FROM r), 6) AS share, round(quantile_cont(value, 0.5), 6) AS median, max(m) AS memory FROM r GROUP BY stage
 UNION ALL SELECT 'real-time', (SELECT count(DISTINCT key) FROM ev), NULL, round((SELECT sum(value) FROM ev) / footage, 9), NULL, NULL FROM f""")
def agg_stage_profile(spark, sf):
    ev = tb.events(spark, sf)
    k = F.get_json_object("props", "$.k")
    r = ev.select(F.col("key").alias("job"), F.concat_ws(" ", "kind", k).alias("stage"), "value", k.cast("long").alias("m"))
    p = ru.stage_profile(r, "job", "stage", "value", "m", 5.0).select(
        "stage", "jobs", F.round("total", 3).alias("total"), F.round("share", 6).alias("share"), F.round("median", 6).alias("median"), "memory")
    per = ev.groupBy("key").agg(((F.max("t") - F.min("t")) / 1e6).alias("f"), F.sum("value").alias("v"))
    null = F.lit(None)
    real = per.agg(F.count(F.lit(1)).alias("jobs"), F.round(F.sum("v") / F.sum("f"), 9).alias("share")).select(
        F.lit("real-time").alias("stage"), "jobs", null.cast("double").alias("total"), "share", null.cast("double").alias("median"), null.cast("long").alias("memory"))
    return p.unionByName(real)


@query("agg_peak_rise", f"""WITH {q.B}, {_INSIDE}, base AS (SELECT key, arg_min(value, (t, id)) AS v0 FROM ev GROUP BY key), pk AS (SELECT bid, max(value) AS v FROM ins WHERE ins.id <> bid GROUP BY bid)
 SELECT b.bid, greatest(0, CAST(round(v - v0) AS BIGINT)) AS rise FROM b JOIN base ON b.key = base.key LEFT JOIN pk ON b.bid = pk.bid""".replace("greatest(0, CAST(round(v - v0) AS BIGINT))", "CASE WHEN v IS NOT NULL THEN greatest(0, CAST(round(v - v0) AS BIGINT)) END"))
def agg_peak_rise(spark, sf):
    base = tb.events(spark, sf).groupBy("key").agg(F.min_by("value", F.struct("t", "id")).alias("v0"))
    peak = _inside(spark, sf).where(F.col("id") != F.col("bid")).groupBy("bid").agg(F.max("value").alias("v"))
    rise = F.greatest(F.lit(0).cast("long"), F.round(F.col("v") - F.col("v0")).cast("long"))
    return spread_join(tb.spans_b(spark, sf), base, "key").join(peak, "bid", "left").select("bid", F.when(F.col("v").isNotNull(), rise).alias("rise"))


@query("agg_downsample", f"""WITH {q.SERIES}, n AS (SELECT *, (row_number() OVER (PARTITION BY key ORDER BY sec) - 1) // 24 AS bucket FROM series)
 SELECT key, bucket, max(abs(loudness)) AS peak FROM n GROUP BY 1, 2 HAVING count(*) = 24""")
def agg_downsample(spark, sf):
    n = ordered_scan(tb.series(spark, sf), ["key"], ["sec"], by_width("sec", 10_000), {"i": row_number()})
    return n.groupBy("key", F.expr("(i - 1) div 24").alias("bucket")).agg(
        F.max(F.abs("loudness")).alias("peak"), F.count(F.lit(1)).alias("c")).where("c = 24").select("key", "bucket", "peak")


_DEFAULTS = {"AUTOMOBILE": 50000.0, "BUILDING": 60000.0, "FURNITURE": 70000.0, "HOUSEHOLD": 80000.0, "MACHINERY": 90000.0}


@query("agg_recent_median", f"""WITH r AS (SELECT o_custkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 5),
 m AS (SELECT o_custkey, quantile_cont(o_totalprice, 0.5) AS mid FROM r GROUP BY 1)
 SELECT c_custkey AS id, mid IS NOT NULL AS measured, round(coalesce(mid, CASE c_mktsegment {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _DEFAULTS.items())} END), 4) AS low, round(mid * 1.5, 4) AS high FROM customer LEFT JOIN m ON c_custkey = o_custkey""")
def agg_recent_median(spark, sf):
    o = tb.load(spark, sf, "orders")
    last = ru.recent(o, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 5)
    mid = last.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.percentile("o_totalprice", 0.5).alias("mid"))
    table = spark.createDataFrame(list(_DEFAULTS.items()), "c_mktsegment string, usual double")
    j = tb.load(spark, sf, "customer").join(mid, "c_custkey", "left").join(F.broadcast(table), "c_mktsegment", "left")
    return j.select(F.col("c_custkey").alias("id"), F.col("mid").isNotNull().alias("measured"), F.round(F.coalesce("mid", "usual"), 4).alias("low"),
                    F.round(F.col("mid") * 1.5, 4).alias("high"))


@query("agg_keep_last_n", "SELECT o_custkey AS key, o_orderkey AS id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 8")
def agg_keep_last_n(spark, sf):
    return ru.recent(tb.load(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), "o_orderdate"),
                     ["key"], [F.col("o_orderdate").desc(), F.col("id").desc()], 8).select("key", "id")


@query("agg_fingerprint", f"""WITH {q.EV}, h AS (SELECT key, md5(length(id::VARCHAR) || ':' || id || length(kind) || ':' || kind || length(t::VARCHAR) || ':' || t) AS h FROM ev)
 SELECT key, sha256('v1/' || count(*) || '/' || sum(('0x' || substr(h, 1, 8))::BIGINT) || '/' || sum(('0x' || substr(h, 9, 8))::BIGINT) || '/' || sum(('0x' || substr(h, 17, 8))::BIGINT) || '/' || sum(('0x' || substr(h, 25, 8))::BIGINT)) AS fingerprint FROM h GROUP BY key""")
def agg_fingerprint(spark, sf):
    return ru.fingerprint(tb.events(spark, sf), ["key"], ["id", "kind", "t"], "v1")


@query("agg_zscore_tags", """WITH x AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS word FROM embeddings),
 w AS (SELECT word, avg(v) AS m, greatest(stddev_pop(v), 1e-6) AS d FROM x GROUP BY word)
 SELECT id, CAST(x.word AS INTEGER) AS word, row_number() OVER (PARTITION BY id ORDER BY (v - m) / d DESC, x.word) AS place FROM x JOIN w ON x.word = w.word QUALIFY place <= 3""")
def agg_zscore_tags(spark, sf):
    x = tb.load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("p", "f")).select(
        "id", (F.col("p") + 1).alias("word"), F.col("f").cast("double").alias("v"))
    w = x.groupBy("word").agg(F.avg("v").alias("m"), F.greatest(F.stddev_pop("v"), F.lit(1e-6)).alias("d"))
    z = x.join(w, "word").withColumn("z", (F.col("v") - F.col("m")) / F.col("d"))
    return ru.recent(z, ["id"], [F.col("z").desc(), F.col("word")], 3, "place").select("id", "word", F.col("place").cast("long").alias("place"))


@query("agg_corrections", """WITH c AS (SELECT l_returnflag AS kind, l_suppkey AS project, l_linestatus = 'O' AS hand, l_quantity / 10 AS edge FROM lineitem)
 SELECT kind, project, GROUPING(kind, project) AS summed, count(*) AS versions, count(*) FILTER (WHERE hand) AS by_hand, count(*) FILTER (WHERE edge <= 1) AS cut_point, count(*) FILTER (WHERE edge > 1) AS wrong_piece, round(quantile_cont(edge, 0.5), 3) AS edge_median, max(edge) AS edge_largest
 FROM c GROUP BY GROUPING SETS ((kind, project), (kind), (project), ())""")
def agg_corrections(spark, sf):
    """Per kind and project, per kind, per project and in total; ``summed`` says which."""
    c = tb.load(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("kind"), F.col("l_suppkey").alias("project"), (F.col("l_linestatus") == "O").cast("long").alias("hand"),
        (F.col("l_quantity") / 10).alias("edge"))
    # Counted by edge length first; every level and its median is read off those counts, expanded once.
    fine = c.groupBy("kind", "project", "edge").agg(F.count(F.lit(1)).alias("n"), F.sum("hand").alias("h"))
    sets = [["kind", "project", "edge"], ["kind", "edge"], ["project", "edge"], ["edge"]]
    per = cut_lineage(fine.groupingSets([[F.col(x) for x in s] for s in sets], "kind", "project", "edge").agg(
        F.shiftright(F.grouping_id(), 1).alias("summed"), F.sum("n").alias("n"), F.sum("h").alias("h")))
    g = ["summed", "kind", "project"]
    run = ordered_scan(per, g, ["edge"], None, {"to": ru.running_sum(F.col("n")), "all": ru.total_sum(F.col("n"))})

    def at(rank):
        return F.max(F.when((F.col("to") - F.col("n") <= rank) & (rank < F.col("to")), F.col("edge")))
    middle = (at(F.floor((F.col("all") - 1) / 2)) + at(F.ceil((F.col("all") - 1) / 2))) / 2
    return run.groupBy(*g).agg(
        F.sum("n").alias("versions"), F.sum("h").alias("by_hand"), F.sum(F.when(F.col("edge") <= 1, F.col("n")).otherwise(0)).alias("cut_point"),
        F.sum(F.when(F.col("edge") > 1, F.col("n")).otherwise(0)).alias("wrong_piece"), F.round(middle, 3).alias("edge_median"), F.max("edge").alias("edge_largest"))


_TRIAL = """t AS (SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'X' WHEN o_orderpriority = '5-LOW' THEN 'same' ELSE 'Y' END AS better,
 CASE o_orderstatus WHEN 'F' THEN 'X' WHEN 'O' THEN 'Y' END AS change, CASE o_orderpriority WHEN '2-HIGH' THEN 'X' WHEN '4-NOT SPECIFIED' THEN 'both' ELSE 'neither' END AS broke,
 CASE WHEN o_totalprice > 200000 THEN 'user' ELSE 'subagent' END AS judge FROM orders)"""


@query("agg_trial_tally", f"""WITH {_TRIAL}, k AS (SELECT judge, CASE WHEN better = change AND broke NOT IN (change, 'both') THEN 'change' ELSE 'original' END AS keep FROM t WHERE change IS NOT NULL)
 SELECT judge, count(*) FILTER (WHERE keep = 'change') AS change, count(*) FILTER (WHERE keep = 'original') AS original FROM k GROUP BY judge""")
def agg_trial_tally(spark, sf):
    p, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    t = tb.load(spark, sf, "orders").select(
        F.when(p.isin("1-URGENT", "2-HIGH"), "X").when(p == "5-LOW", "same").otherwise("Y").alias("better"),
        F.when(st == "F", "X").when(st == "O", "Y").alias("change"),
        F.when(p == "2-HIGH", "X").when(p == "4-NOT SPECIFIED", "both").otherwise("neither").alias("broke"),
        F.when(F.col("o_totalprice") > 200000, "user").otherwise("subagent").alias("judge")).where(F.col("change").isNotNull())
    keep = F.when((F.col("better") == F.col("change")) & (F.col("broke") != F.col("change")) & (F.col("broke") != "both"), "change").otherwise("original")
    return t.withColumn("keep", keep).groupBy("judge").pivot(
        "keep", ["change", "original"]).agg(F.count(F.lit(1)))
