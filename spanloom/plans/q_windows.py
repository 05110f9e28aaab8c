"""Queries of the window and sequence rules."""

from __future__ import annotations

import unicodedata
from itertools import groupby

from pyspark.sql import functions as F

from ..functions.text import normalized
from ..operators import intervals as iv
from ..operators import sequence as sq
from ..operators.ordered import (by_width, exact_quantiles, first_value, islands, last_value, nxt, ordered_scan, prev, row_number,
                                 running_max, running_sum, spread_join)
from ..operators.transcript import bare
from ..session import cut_lineage
from ..sources import tables as tb
from . import sqlbase as q
from .registry import query

def _by_ord():
    return by_width("ord", 1_000_000)


@query("win_runs", f"""WITH {q.WORDS}, f AS (SELECT *, prob < 0.2 AS d, lag(prob < 0.2) OVER (PARTITION BY key ORDER BY ord) AS pd FROM words),
 g AS (SELECT *, sum(CASE WHEN pd IS NULL OR pd <> d THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ord) AS grp FROM f)
 SELECT key, min(ord) AS first, max(ord) AS last, count(*) AS words FROM g WHERE d GROUP BY key, grp""")
def win_runs(spark, sf):
    w = tb.words(spark, sf).withColumn("d", F.col("prob") < 0.2)
    r = islands(w, ["key"], ["ord"], _by_ord(), {"__p": prev(F.col("d"))}, F.col("d") != F.col("__p"))
    return r.where("d").groupBy("key", "grp").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.count(F.lit(1)).alias("words")).drop("grp")


_QUIET = 400_000


@query("win_phrase_start", f"""WITH {q.WORDS}, l AS (SELECT *, lag(s) OVER o AS ps, lag(e) OVER o AS pe, lag(text) OVER o AS pt FROM words WINDOW o AS (PARTITION BY key ORDER BY ord)),
 qt AS (SELECT key, s AS stops, e AS resumes FROM words WHERE e - s BETWEEN 1 AND {_QUIET})
 SELECT key, ord, coalesce(ps IS NULL OR s - pe >= 200000 OR regexp_matches(pt, '[。！？!?…，,、；;：:]$') OR idx = 0
  OR EXISTS (SELECT 1 FROM qt WHERE qt.key = l.key AND stops >= ps AND stops <= l.e AND resumes <= l.e AND (resumes >= pe - 20000 OR stops - ps > pe - resumes) AND NOT (stops = l.s AND resumes = l.e) AND NOT (stops = ps AND resumes = pe)), false) AS begins FROM l""")
def win_phrase_start(spark, sf):
    w = tb.words(spark, sf, only=(), first=F.col("idx") == 0, breaks=F.col("text").rlike("[。！？!?…，,、；;：:]$")).drop("prob")
    l = cut_lineage(ordered_scan(w, ["key"], ["ord"], _by_ord(), {"ps": prev(F.col("s")), "pe": prev(F.col("e")), "after": prev(F.col("breaks"))}).drop("breaks"))
    quiet = w.where((F.col("e") > F.col("s")) & (F.col("e") - F.col("s") <= _QUIET)).select("key", F.col("s").alias("stops"), F.col("e").alias("resumes"))
    pairs = iv.overlap_join(l.where("ps is not null").select("key", "ord", "ps", "pe", "s", "e"), quiet, ["key"], ("ps", "e"), ("stops", "resumes"), 2 * tb.SECOND, touching=True)
    hit = pairs.where("stops >= ps and resumes <= e and (resumes >= pe - 20000 or stops - ps > pe - resumes)").where(
        "not (stops = s and resumes = e) and not (stops = ps and resumes = pe)").select("key", "ord").distinct().withColumn("__q", F.lit(True))
    flag = F.col("ps").isNull() | (F.col("s") - F.col("pe") >= 200_000) | F.col("after") | F.col("first") | F.coalesce("__q", F.lit(False))
    return l.join(hit, ["key", "ord"], "left").select("key", "ord", flag.alias("begins"))


_SPLIT = f"""l AS (SELECT *, lag(e) OVER o AS pe, lag(text) OVER o AS pt FROM words WINDOW o AS (PARTITION BY key ORDER BY ord)),
 g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s - pe >= 600000 OR regexp_matches(pt, '[。！？!?.]$') THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ord) AS sent FROM l)"""


def _split(spark, sf, only=("turn", "idx", "speaker", "text")):
    w = tb.words(spark, sf, only, ends=F.col("text").rlike("[。！？!?.]$")).drop("prob")
    starts = (F.col("s") - F.col("pe") >= 600_000) | F.col("pt")
    return islands(w, ["key"], ["ord"], _by_ord(), {"pe": prev(F.col("e")), "pt": prev(F.col("ends"))}, starts, "sent").drop("ends", "pe", "pt")


@query("win_split_sentences", f"""WITH {q.WORDS}, {_SPLIT} SELECT key, sent, min(s) AS s, max(e) AS e, string_agg(text, ' ' ORDER BY ord) AS text FROM g GROUP BY key, sent""")
def win_split_sentences(spark, sf):
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ")
    return _split(spark, sf).groupBy("key", "sent").agg(F.min("s").alias("s"), F.max("e").alias("e"), text.alias("text"))


@query("win_split_long")
def win_split_long(spark, sf):
    return sq.long_pieces(_split(spark, sf, ()), ["key", "sent"], "ord", "s", "e", 4 * tb.SECOND, 100_000)


_GAP = 12 * tb.HOUR


@query("win_sessions", f"""WITH {q.EV}, l AS (SELECT *, lag(t) OVER (PARTITION BY key ORDER BY t, id) AS pt FROM ev),
 g AS (SELECT *, sum(CASE WHEN pt IS NULL OR t - pt > {_GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY t, id) AS sitting FROM l)
 SELECT key, sitting, min(t) AS s, max(t) AS e, count(*) AS n, max(t) - min(t) + 60000000 AS counted_us FROM g GROUP BY key, sitting""")
def win_sessions(spark, sf):
    ev = tb.events(spark, sf).select("key", "t", "id")
    r = islands(ev, ["key"], ["t", "id"], by_width("t", tb.CHUNK), {"pt": prev(F.col("t"))}, F.col("t") - F.col("pt") > _GAP, "sitting")
    return r.groupBy("key", "sitting").agg(F.min("t").alias("s"), F.max("t").alias("e"), F.count(F.lit(1)).alias("n"),
                                           (F.max("t") - F.min("t") + 60 * tb.SECOND).alias("counted_us"))


_VOC = """tk AS (SELECT conv_id AS key, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM conversations),
 n AS (SELECT key, turn, token, count(*) AS n FROM tk GROUP BY 1, 2, 3), sd AS (SELECT key, turn + d AS b, token, n AS l, 0 AS r FROM n, range(1, 4) x(d) UNION ALL SELECT key, turn - d, token, 0, n FROM n, range(0, 3) x(d)),
 bt AS (SELECT key, b, token, sum(l) AS l, sum(r) AS r FROM sd GROUP BY 1, 2, 3), ov AS (SELECT key, b, sum(l * r) / sqrt(sum(l * l)::DOUBLE * sum(r * r)) AS o FROM bt GROUP BY 1, 2 HAVING sum(l * l) > 0 AND sum(r * r) > 0),
 al AS (SELECT c.conv_id AS key, c.turn AS b, round(o, 9) AS o FROM conversations c LEFT JOIN ov ON ov.key = c.conv_id AND ov.b = c.turn WHERE c.turn > 0)"""


def _turnover(spark, sf):
    c = tb.load(spark, sf, "conversations").select(F.col("conv_id").alias("key"), "turn", "text")
    tokens = c.select("key", "turn", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("token"))
    ov = sq.vocabulary_overlap(tokens, ["key"], "turn")
    rows = c.where("turn > 0").select("key", "turn").join(ov, ["key", "turn"], "left").withColumn("overlap", F.round("overlap", 9))
    return sq.turnover(rows, ["key"], "turn")


@query("win_turnover", f"""WITH {_VOC}, m AS (SELECT *, CASE WHEN lag(o) OVER w IS NULL OR lag(o) OVER w < o THEN o END AS lp, CASE WHEN lead(o) OVER w IS NULL OR lead(o) OVER w < o THEN o END AS rp FROM al WINDOW w AS (PARTITION BY key ORDER BY b)),
 p AS (SELECT *, last_value(lp IGNORE NULLS) OVER (PARTITION BY key ORDER BY b) AS l, first_value(rp IGNORE NULLS) OVER (PARTITION BY key ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM m)
 SELECT key, b AS turn, round(o, 6) AS overlap, CASE WHEN o IS NULL THEN 0.0::DOUBLE ELSE round(least(1.0, (l - o) + (r - o)), 6) END AS depth FROM p""")
def win_turnover(spark, sf):
    return _turnover(spark, sf).select("key", "turn", F.round("overlap", 6).alias("overlap"), F.round("depth", 6).alias("depth"))


@query("win_boundary_candidates", f"""WITH {q.AB}, x AS (SELECT a.*, lag(id) OVER (PARTITION BY key ORDER BY s, id) AS pid FROM a),
 pz AS (SELECT x.id, arg_min(be - bs, (bs, bid)) AS pause FROM x JOIN b ON x.key = b.key AND bs - 20000 <= s AND s <= be + 20000 GROUP BY x.id),
 sh AS (SELECT x.id, count(*) AS n FROM x JOIN ev ON x.key = ev.key AND ev.kind = 'error' AND ev.t >= s - {6 * q.HOUR} AND ev.t <= s + {6 * q.HOUR} GROUP BY x.id),
 sc AS (SELECT x.key, x.id, x.s, round(0.45 * least(1, coalesce(pause, 0) / {float(24 * q.HOUR)}) + 0.15 * CASE WHEN kind = 'signup' THEN 1 ELSE 0 END + 0.10 * least(1, coalesce(n, 0) / 3.0::DOUBLE), 12) AS score FROM x LEFT JOIN pz ON x.id = pz.id LEFT JOIN sh ON x.id = sh.id WHERE pid IS NOT NULL),
 kp AS (SELECT key, greatest(12, CAST(round((max(t) - min(t)) / {float(24 * q.HOUR)} * 0.8) AS BIGINT)) AS keep FROM ev GROUP BY key),
 rk AS (SELECT sc.*, keep, row_number() OVER (PARTITION BY sc.key ORDER BY score DESC, s, id) AS rn FROM sc JOIN kp ON sc.key = kp.key WHERE score > 0)
 SELECT key, id, s, score FROM rk WHERE rn <= keep""")
def win_boundary_candidates(spark, sf):
    a, b = tb.spans_a(spark, sf), tb.spans_b(spark, sf)
    x = cut_lineage(ordered_scan(a, ["key"], ["s", "id"], by_width("s", tb.CHUNK), {"pid": prev(F.col("id"))}).where("pid is not null"))
    pause = iv.point_join(x.select("key", "id", "s"), b, ["key"], "s", ("bs", "be"), tb.BIN, edges="[]", tolerance=20_000).groupBy("id").agg(
        F.min_by(F.col("be") - F.col("bs"), F.struct("bs", "bid")).alias("pause"))
    near = tb.moments(spark, sf).select("key", (F.col("t") - 6 * tb.HOUR).alias("w0"), (F.col("t") + 6 * tb.HOUR).alias("w1"))
    shots = iv.point_join(x.select("key", "id", "s"), near, ["key"], "s", ("w0", "w1"), tb.BIN, edges="[]").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    w = sq.SIGNAL_WEIGHTS
    zero = F.lit(0).cast("long")
    score = (w["pause"] * F.least(F.lit(1.0), F.coalesce("pause", zero) / float(tb.DAY)) + w["marker"] * (F.col("kind") == "signup").cast("double")
             + w["shots"] * F.least(F.lit(1.0), F.coalesce("n", zero) / 3.0))
    sc = x.join(pause, "id", "left").join(shots, "id", "left").withColumn("score", F.round(score, 12)).where("score > 0")
    keep = tb.events(spark, sf).groupBy("key").agg(F.greatest(F.lit(12).cast("long"), F.round((F.max("t") - F.min("t")) / float(tb.DAY) * 0.8).cast("long")).alias("keep"))
    sc = sc.withColumn("neg", -F.col("score")).select("key", "id", "s", "score", "neg")
    # Ranked in slices of the score, so the strongest are found without sorting a key in one task.
    rk = ordered_scan(sc, ["key"], ["neg", "s", "id"], F.floor(F.col("neg") * 100), {"rn": row_number()})
    rk = spread_join(rk, keep, "key")
    return rk.where("rn <= keep").select("key", "id", "s", "score")


_EN = f"""sm AS (SELECT *, (coalesce(lag(loudness) OVER w, loudness) + loudness + coalesce(lead(loudness) OVER w, loudness)) / 3 AS sl, row_number() OVER w AS i FROM series WINDOW w AS (PARTITION BY key ORDER BY sec)),
 qq AS (SELECT key, quantile_cont(sl, 0.10) AS lo, quantile_cont(sl, 0.95) AS hi FROM sm GROUP BY key),
 en AS (SELECT sm.key, sec, i, round(greatest(0.0, least(1.0, (sl - lo) / greatest(hi - lo, 1e-6))), 6) AS energy FROM sm JOIN qq ON sm.key = qq.key)"""


def _energy(spark, sf):
    chunk = by_width("sec", sq.BLOCK)
    c = sq.energy_curve(tb.series(spark, sf), ["key"], "sec", "loudness", chunk).select("key", "sec", F.round("energy", 6).alias("energy"))
    return cut_lineage(sq.numbered(c, ["key"], ["sec"], chunk))


@query("win_energy_curve", f"WITH {q.SERIES}, {_EN} SELECT key, sec, energy FROM en")
def win_energy_curve(spark, sf):
    return _energy(spark, sf).select("key", "sec", "energy")


@query("win_level_sections")
def win_level_sections(spark, sf):
    return sq.level_sections(_energy(spark, sf), "key", "i", by_width("i", sq.BLOCK))


@query("win_fullest", f"""WITH {q.SERIES}, {_EN}, s AS (SELECT key, i, round(sum(energy) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), 6) AS t, count(*) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS n FROM en)
 SELECT key, i AS start, i + 8 AS "end" FROM s WHERE n = 8 QUALIFY row_number() OVER (PARTITION BY key ORDER BY t DESC, i) = 1""")
def win_fullest(spark, sf):
    return sq.fullest(_energy(spark, sf), "key", "i")


@query("win_ending", f"""WITH {q.SERIES}, {_EN}, n AS (SELECT *, max(i) OVER (PARTITION BY key) - i AS b FROM en), g AS (SELECT key, max(energy) FILTER (WHERE b <= 1) AS l2, max(energy) FILTER (WHERE b IN (4, 5)) AS f2, max(energy) FILTER (WHERE b = 0) AS l FROM n GROUP BY key)
 SELECT key, CASE WHEN l2 < 0.25 AND f2 > l + 0.2 THEN 'fades out' WHEN l2 >= 0.6 THEN 'ends full' ELSE 'ends quietly' END AS ends FROM g""")
def win_ending(spark, sf):
    return sq.ending(_energy(spark, sf), "key", "i")


@query("win_loop_points", f"""WITH {q.SERIES}, {_EN}, d AS (SELECT key, max(i) AS dur FROM en GROUP BY key),
 bars AS (SELECT key, i AS x, (i - 1) // 4 AS n FROM en WHERE (i - 1) % 4 = 0),
 sd AS (SELECT bars.*, avg(energy) FILTER (WHERE i < x) AS bef, avg(energy) FILTER (WHERE i >= x) AS aft FROM bars JOIN en ON bars.key = en.key AND i BETWEEN x - 2 AND x + 1 GROUP BY ALL),
 pr AS (SELECT p.key, p.x AS s, r.x AS e, round(abs(p.aft - r.aft) + abs(coalesce(p.bef, p.aft) - r.bef), 1) AS m FROM sd p JOIN sd r ON p.key = r.key AND r.n >= p.n + 8 JOIN d ON d.key = p.key WHERE p.aft >= 0.35 AND r.bef >= 0.35 AND r.aft IS NOT NULL AND r.x - 1 <= dur - 2)
 SELECT key, s AS start, e AS "end" FROM pr QUALIFY row_number() OVER (PARTITION BY key ORDER BY m, s - e, s) = 1""")
def win_loop_points(spark, sf):
    c = _energy(spark, sf)
    return sq.loop_points(c, c.select("key", "i"), "key", "i", "i")


@query("win_period", f"""WITH {q.SERIES}, x AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY sec) AS i, loudness AS v FROM series),
 f AS (SELECT key, i, coalesce(greatest(0, v - lag(v) OVER (PARTITION BY key ORDER BY i)), 0) AS f FROM x),
 e AS (SELECT key, i, greatest(0, f - sum(f) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN 24 PRECEDING AND 24 FOLLOWING) / 49) AS e FROM f),
 c AS (SELECT key, i, e - avg(e) OVER (PARTITION BY key) AS x FROM e),
 r AS (SELECT p.key, l.lag, sum(p.x * n.x) AS c FROM c p JOIN range(3, 50) l(lag) ON true JOIN c n ON n.key = p.key AND n.i = p.i - l.lag GROUP BY 1, 2),
 b AS (SELECT key, lag, c FROM r WHERE lag BETWEEN 4 AND 48 QUALIFY row_number() OVER (PARTITION BY key ORDER BY c * exp(-0.5 * pow(log2(24.0 / lag) / 0.9, 2)) DESC, lag) = 1),
 p AS (SELECT b.key, b.lag, b.c AS m, l.c AS l, n.c AS n FROM b JOIN r l ON l.key = b.key AND l.lag = b.lag - 1 JOIN r n ON n.key = b.key AND n.lag = b.lag + 1)
 SELECT key, round(lag + CASE WHEN l - 2 * m + n < 0 THEN 0.5 * (l - n) / (l - 2 * m + n) ELSE 0 END, 5) AS period FROM p""")
def win_period(spark, sf):
    x = cut_lineage(sq.numbered(tb.series(spark, sf).select("key", "sec", "loudness"), ["key"], ["sec"], by_width("sec", sq.BLOCK)).select("key", "i", "loudness"))
    return sq.period(x, "key", "i", "loudness", 4, 48, 24.0, 0.9, 24).select("key", F.round("period", 5).alias("period"))


@query("win_lag_search", f"""WITH {q.SERIES}, v AS (SELECT sec, loudness AS b FROM series WHERE key = 'view'),
 c AS (SELECT s.key, l.lag, round(corr(s.loudness, b), 9) AS c FROM series s JOIN range(-12, 13) l(lag) ON true JOIN v ON v.sec = s.sec + l.lag WHERE s.key <> 'view' GROUP BY 1, 2),
 k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY c DESC, abs(lag), lag) = 1)
 SELECT key, CASE WHEN c >= 0.05 THEN CAST(lag AS INTEGER) END AS lag, round(c, 6) AS corr, c >= 0.05 AND abs(lag) >= 12 AS beyond FROM k""")
def win_lag_search(spark, sf):
    s = tb.series(spark, sf).select("key", "sec", "loudness")
    view = s.where("key = 'view'").select("sec", F.col("loudness").alias("other"))
    out = sq.lag_search(s.where("key <> 'view'"), view, ["key"], "sec", "loudness", "other", 12, 0.05)
    return out.select("key", "lag", F.round("corr", 6).alias("corr"), "beyond")


def _flash_sql():
    parts = []
    for n in (1, 2, 3):
        jumps = [f"(lead(v, {k}) OVER w - lag(v) OVER w)" if k else "(v - lag(v) OVER w)" for k in range(n)]
        up, down = " AND ".join(f"{j} >= 3" for j in jumps), " AND ".join(f"{j} <= -3" for j in jumps)
        parts.append(f"WHEN (({up}) OR ({down})) AND abs(lead(v, {n}) OVER w - lag(v) OVER w) <= 1.5 THEN {n}")
    return "CASE " + " ".join(parts) + " END"


@query("win_flash", f"""WITH RECURSIVE {q.SERIES}, x AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY sec) AS i, loudness AS v FROM series),
 c AS (SELECT key, i, run FROM (SELECT key, i, {_flash_sql()} AS run FROM x WINDOW w AS (PARTITION BY key ORDER BY i)) WHERE run IS NOT NULL),
 r AS (SELECT key, 0::BIGINT AS i, 0 AS run, 1::BIGINT AS resume FROM (SELECT DISTINCT key FROM c) UNION ALL
  SELECT key, i, run, i + run + 1 FROM (SELECT c.key, c.i, c.run, row_number() OVER (PARTITION BY c.key ORDER BY c.i) AS rn FROM r JOIN c ON c.key = r.key AND c.i >= r.resume) WHERE rn = 1)
 SELECT key, i, run FROM r WHERE i > 0""")
def win_flash(spark, sf):
    x = cut_lineage(sq.numbered(tb.series(spark, sf).select("key", "sec", "loudness"), ["key"], ["sec"], by_width("sec", sq.BLOCK)))
    return sq.flashes(x, ["key"], "i", "loudness", 3.0).select("key", "i", "run")


@query("win_loud_uncovered", f"""WITH {q.AB}, {q.BC}, f AS (SELECT a.*, value >= 20 AND NOT EXISTS (SELECT 1 FROM bc WHERE bc.key = a.key AND cs < e AND ce > s) AS loud FROM a),
 g AS (SELECT *, sum(CASE WHEN loud IS DISTINCT FROM pl THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY s, id) AS grp FROM (SELECT *, lag(loud) OVER (PARTITION BY key ORDER BY s, id) AS pl FROM f))
 SELECT key, min(s) AS s, max(e) AS e FROM g WHERE loud GROUP BY key, grp HAVING max(e) - min(s) >= {12 * q.HOUR}""")
def win_loud_uncovered(spark, sf):
    a = tb.spans_a(spark, sf)
    hit = iv.overlap_join(a.select("key", "id", "s", "e"), tb.spans_b(spark, sf), ["key"], ("s", "e"), ("bs", "be"), tb.BIN).select("id").distinct().withColumn("__h", F.lit(True))
    f = a.join(hit, "id", "left").withColumn("loud", (F.col("value") >= 20) & F.col("__h").isNull())
    r = islands(cut_lineage(f), ["key"], ["s", "id"], by_width("s", tb.CHUNK), {"pl": prev(F.col("loud"))}, F.col("loud") != F.col("pl"))
    return r.where("loud").groupBy("key", "grp").agg(F.min("s").alias("s"), F.max("e").alias("e")).where(
        F.col("e") - F.col("s") >= 12 * tb.HOUR).drop("grp")


@query("win_hysteresis")
def win_hysteresis(spark, sf):
    ev = tb.events(spark, sf).withColumn("clip", F.expr(f"t div {7 * tb.DAY}"))
    closed = ev.groupBy("key", "clip").agg((F.max("t") / tb.HOUR).alias("closed"))
    x = ev.select("key", "clip", (F.col("t") / tb.HOUR).alias("at"), (F.least(F.col("value"), F.lit(200.0)) / 200).alias("where")).join(closed, ["key", "clip"])
    return sq.hysteresis(x, ["key", "clip"], 0.1, 2.0, 1.5)


_SHOTS = f"""sx AS (SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY value, id) AS i, CASE WHEN kind <> 'error' THEN t END AS moment, kind AS topic, kind = 'signup' AND value > 60 AS opens, value > 200 AS exempt, CAST(json_extract(props, '$.k') AS BIGINT) / 100 AS exposure FROM ev)"""


def _shots(spark, sf):
    ev = tb.events(spark, sf).select(
        "key", "id", "value", F.when(F.col("kind") != "error", F.col("t")).alias("moment"), F.col("kind").alias("topic"),
        ((F.col("kind") == "signup") & (F.col("value") > 60)).alias("opens"), (F.col("value") > 200).alias("exempt"),
        (F.get_json_object("props", "$.k").cast("long") / 100).alias("exposure"))
    return cut_lineage(sq.numbered(ev, ["key"], ["value", "id"], F.floor("value")))


_NEAR, _FAR = 3 * tb.DAY, 5 * tb.DAY


def _stray_sql():
    whens = []
    for n in (1, 2):
        mid = list(range(n))

        def at(c, k):
            return f"lag({c}) OVER w" if k < 0 else (c if k == 0 else f"lead({c}, {k}) OVER w")
        clear = " AND ".join([f"NOT {at('opens', n)}"] + [f"NOT {at('opens', k)} AND NOT {at('exempt', k)}" for k in mid])
        low, high = f"least({at('moment', -1)}, {at('moment', n)})", f"greatest({at('moment', -1)}, {at('moment', n)})"
        known = f"{at('moment', -1)} IS NOT NULL AND {at('moment', n)} IS NOT NULL AND {high} - {low} <= {_NEAR}"
        off = " AND ".join(f"{at('moment', k)} IS NOT NULL AND greatest({low} - {at('moment', k)}, {at('moment', k)} - {high}) >= {_FAR}" for k in mid)
        topic = f"{at('topic', -1)} = {at('topic', n)} AND " + " AND ".join(f"{at('topic', k)} <> {at('topic', -1)}" for k in mid)
        whens.append(f"WHEN {clear} AND {known} AND {off} THEN 'time/{n}' WHEN {clear} AND {topic} THEN 'topic/{n}'")
    return "CASE " + " ".join(whens) + " END"


_STRAY = f"""cd AS (SELECT key, i, split_part(f, '/', 1) AS why, CAST(split_part(f, '/', 2) AS INTEGER) AS run FROM (SELECT key, i, {_stray_sql()} AS f FROM sx WINDOW w AS (PARTITION BY key ORDER BY i)) WHERE f IS NOT NULL),
 sr AS (SELECT key, 0::BIGINT AS i, '' AS why, 0 AS run, 1::BIGINT AS resume FROM (SELECT DISTINCT key FROM cd) UNION ALL
  SELECT key, i, why, run, i + run + 1 FROM (SELECT cd.key, cd.i, cd.why, cd.run, row_number() OVER (PARTITION BY cd.key ORDER BY cd.i) AS rn FROM sr JOIN cd ON cd.key = sr.key AND cd.i >= sr.resume) WHERE rn = 1)"""


@query("win_strays", f"WITH RECURSIVE {q.EV}, {_SHOTS}, {_STRAY} SELECT key, i, run, why FROM sr WHERE i > 0")
def win_strays(spark, sf):
    return sq.strays(_shots(spark, sf), ["key"], "i", _NEAR, _FAR).select("key", "i", "run", "why")


@query("win_backward", f"""WITH RECURSIVE {q.EV}, {_SHOTS}, {_STRAY}, pt AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY i) AS part FROM sx),
 kp AS (SELECT pt.*, lag(i) OVER w AS bi, lag(moment) OVER w AS bm, lag(exposure) OVER w AS bx FROM pt WHERE NOT exempt AND NOT EXISTS (SELECT 1 FROM sr WHERE sr.key = pt.key AND sr.i > 0 AND pt.i >= sr.i AND pt.i < sr.i + sr.run) WINDOW w AS (PARTITION BY key, part ORDER BY i))
 SELECT key, bi AS before, i AS after, CASE WHEN bm IS NOT NULL AND moment IS NOT NULL THEN CASE WHEN bm - moment >= {_FAR} THEN 'time' END WHEN bx <= 0.2 AND exposure >= 0.6 THEN 'light' END AS by FROM kp
 WHERE bi IS NOT NULL AND CASE WHEN bm IS NOT NULL AND moment IS NOT NULL THEN bm - moment >= {_FAR} ELSE bx <= 0.2 AND exposure >= 0.6 END""")
def win_backward(spark, sf):
    shots = _shots(spark, sf)
    stray = cut_lineage(sq.strays(shots, ["key"], "i", _NEAR, _FAR))
    return sq.backward_steps(shots, ["key"], "i", stray, _FAR, 0.2, 0.6)


@query("win_step_back_20m", f"""WITH {q.EV}, {_SHOTS}, d AS (SELECT key, i, moment, lag(moment) OVER w AS bm, lag(i) OVER w AS bi FROM sx WHERE moment IS NOT NULL WINDOW w AS (PARTITION BY key ORDER BY i))
 SELECT key, bi AS before, i AS after, bm - moment AS back_us, NULL AS unchecked FROM d WHERE bm - moment > {20 * tb.DAY}
 UNION ALL SELECT key, NULL, NULL, NULL, count(*) FROM sx WHERE moment IS NULL GROUP BY key""")
def win_step_back_20m(spark, sf):
    x = _shots(spark, sf)
    dated = F.when(F.col("moment").isNotNull(), F.struct("moment", "i"))
    d = ordered_scan(x, ["key"], ["i"], by_width("i", sq.BLOCK), {"b": last_value(dated, inclusive=False)})
    null = F.lit(None).cast("long")
    steps = d.where(F.col("b.moment") - F.col("moment") > 20 * tb.DAY).select(
        "key", F.col("b.i").alias("before"), F.col("i").alias("after"), (F.col("b.moment") - F.col("moment")).alias("back_us"), null.alias("unchecked"))
    undated = x.where("moment is null").groupBy("key").agg(F.count(F.lit(1)).alias("unchecked")).select(
        "key", null.alias("before"), null.alias("after"), null.alias("back_us"), "unchecked")
    return steps.unionByName(undated)


_RET = """rp AS (SELECT key, i, topic, lag(topic) OVER (PARTITION BY key ORDER BY i) AS pt FROM sx WHERE topic <> 'error'),
 rn AS (SELECT *, sum(CASE WHEN pt IS NULL OR pt <> topic THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY i) AS run FROM rp),
 rt AS (SELECT key, run, topic, min(i) AS f, max(i) AS l FROM rn GROUP BY 1, 2, 3),
 ry AS (SELECT *, lag(run) OVER w AS pr, lag(l) OVER w AS pl FROM rt WINDOW w AS (PARTITION BY key, topic ORDER BY run))"""


@query("win_topic_returns", f"WITH {q.EV}, {_SHOTS}, {_RET} SELECT key, topic, pl AS left_at, f AS back_at, CAST(run - pr - 1 AS BIGINT) AS between FROM ry WHERE pr IS NOT NULL")
def win_topic_returns(spark, sf):
    x = _shots(spark, sf).withColumn("topic", F.when(F.col("topic") != "error", F.col("topic")))
    return sq.topic_returns(x, ["key"], "i", "topic")


_PHRASES = ("thethe", "laoi", "derver", "and")


@query("win_closing_early", f"""WITH {q.WORDS}, bw AS (SELECT *, lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS bare FROM words),
 cu AS (SELECT *, sum(length(bare)) OVER (PARTITION BY key, turn ORDER BY ord) AS c FROM bw), ln AS (SELECT key, turn, string_agg(bare, '' ORDER BY ord) AS t FROM bw GROUP BY 1, 2), fin AS (SELECT key, max(e) AS fin FROM words GROUP BY key),
 ph AS (SELECT key, turn, t, unnest([{', '.join(f"'{p}'" for p in _PHRASES)}]) AS phrase, unnest(range(0, {len(_PHRASES)})) AS n FROM ln),
 ht AS (SELECT ph.key, ph.turn, ph.phrase, ph.n, arg_min(cu.s, cu.ord) AS said_at FROM ph JOIN cu ON cu.key = ph.key AND cu.turn = ph.turn AND c >= instr(t, phrase) + length(phrase) - 1 WHERE instr(t, phrase) > 0 GROUP BY 1, 2, 3, 4)
 SELECT ht.key, turn, arg_min(phrase, n) AS phrase, arg_min(said_at, n) AS "at" FROM ht JOIN fin ON ht.key = fin.key WHERE fin - said_at > 10000000 GROUP BY ht.key, turn""")
def win_closing_early(spark, sf):
    w = tb.words(spark, sf)
    fin = w.groupBy("key").agg(F.max("e").alias("fin"))
    return sq.closing_early(w, ["key"], "turn", "ord", "s", F.lower(bare(F.col("text"))), fin, _PHRASES)


@query("win_late_first", f"""WITH {q.EV}, g AS (SELECT key, max(t) - min(t) AS len, min(t) AS t0, min(t) FILTER (WHERE kind = 'purchase' AND value > 120) AS f FROM ev GROUP BY key)
 SELECT key, f - t0 AS first_us, CASE WHEN f IS NULL THEN 'nothing' ELSE 'late' END AS what FROM g WHERE f IS NULL OR f - t0 > least({15 * tb.DAY}, 0.15 * len)""")
def win_late_first(spark, sf):
    g = tb.events(spark, sf).groupBy("key").agg((F.max("t") - F.min("t")).alias("len"), F.min("t").alias("t0"), F.min(
        F.when((F.col("kind") == "purchase") & (F.col("value") > 120), F.col("t"))).alias("f"))
    late = F.col("f") - F.col("t0") > F.least(F.lit(float(15 * tb.DAY)), 0.15 * F.col("len"))
    return g.where(F.col("f").isNull() | late).select("key", (F.col("f") - F.col("t0")).alias("first_us"), F.when(F.col("f").isNull(), "nothing").otherwise("late").alias("what"))


@query("win_file_order", """WITH f AS (SELECT source AS key, doc_id AS id, n_chars AS number FROM documents WHERE n_chars < 10000),
 m AS (SELECT *, max(number) OVER (PARTITION BY key ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM f) SELECT key, id, number, top AS after FROM m WHERE number < top""")
def win_file_order(spark, sf):
    f = tb.load(spark, sf, "documents").select(F.col("source").alias("key"), F.col("doc_id").alias("id"),
                                               F.concat(F.col("n_chars").cast("string"), F.lit("_take.mov")).alias("name"))
    number = F.regexp_extract("name", r"^\(?(\d{1,4})\s*[-_.、)\s]", 1)
    f = f.where(number != "").withColumn("number", number.cast("long"))
    m = ordered_scan(f, ["key"], ["id"], by_width("id", sq.BLOCK), {"top": running_max(F.col("number"), inclusive=False)})
    return m.where("number < top").select("key", "id", "number", F.col("top").alias("after"))


_TRANS = f"""lay AS (SELECT key, id, tl AS o, tl + CAST(round(value * 60 * 1000000) AS BIGINT) AS c FROM pl WHERE kind = 'purchase')"""


@query("win_transitions", f"""WITH {q.PLACED}, {_TRANS}, sq AS (SELECT key, tl AS at, lag(id) OVER (PARTITION BY key ORDER BY pos) AS before, id AS after, 'cut' AS kind FROM pl)
 SELECT * FROM sq WHERE before IS NOT NULL UNION ALL SELECT lay.key, o, p.id, lay.id, 'in' FROM lay LEFT JOIN pl p ON p.key = lay.key AND p.tl <= o - 1000 AND o - 1000 < p.tle
 UNION ALL SELECT lay.key, c, lay.id, p.id, 'out' FROM lay LEFT JOIN pl p ON p.key = lay.key AND p.tl <= c AND c < p.tle""")
def win_transitions(spark, sf):
    pl = cut_lineage(tb.placements(spark, sf))
    cuts = ordered_scan(pl, ["key"], ["pos"], by_width("pos", sq.BLOCK), {"before": prev(F.col("id"))}).where("before is not null").select(
        "key", F.col("tl").alias("at"), "before", F.col("id").alias("after"), F.lit("cut").alias("kind"))
    lay = pl.where("kind = 'purchase'").select("key", "id", F.col("tl").alias("o"), (F.col("tl") + F.round(F.col("value") * 60 * tb.SECOND).cast("long")).alias("c"))
    marks = lay.select("key", "id", F.explode(F.array(F.struct(F.lit("in").alias("kind"), F.col("o").alias("at"), F.greatest(F.lit(0).cast("long"), F.col("o") - 1000).alias("look"), (F.col("o") < 1000).alias("none")),
                                                     F.struct(F.lit("out").alias("kind"), F.col("c").alias("at"), F.col("c").alias("look"), F.lit(False).alias("none")))).alias("m")).select("key", "id", "m.*")
    under = iv.point_join(marks.where("not none"), pl.select("key", F.col("id").alias("under"), "tl", "tle"), ["key"], "look", ("tl", "tle"), tb.BIN).select("id", "kind", "under")
    j = marks.join(under, ["id", "kind"], "left")
    return cuts.unionByName(j.select("key", "at", F.when(F.col("kind") == "in", F.col("under")).otherwise(F.col("id")).alias("before"),
                                     F.when(F.col("kind") == "in", F.col("id")).otherwise(F.col("under")).alias("after"), "kind"))


@query("win_queue_position", "SELECT o_orderkey AS job, row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) - 1 AS place FROM orders WHERE o_orderstatus = 'P'")
def win_queue_position(spark, sf):
    o = tb.load(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("job"), "o_orderpriority", tb.micros("o_orderdate").alias("t"))
    span = 10_000 * tb.DAY * 10
    # Priority and arrival as one rising number, so one queue of any length is ranked in slices of an hour.
    o = o.withColumn("rank", F.substring("o_orderpriority", 1, 1).cast("long") * span + F.col("t")).withColumn("one", F.lit(1))
    return ordered_scan(o, ["one"], ["rank", "job"], by_width("rank", tb.HOUR), {"n": row_number()}).select("job", (F.col("n") - 1).alias("place"))


@query("win_named_early", f"""WITH {q.TURNS}, nm AS (SELECT conv_id AS key, lower(regexp_extract(text, '[\\p{{L}}]+')) AS name FROM conversations WHERE role = 'system')
 SELECT t.key, CASE WHEN any_value(name) IS NULL THEN NULL ELSE coalesce(bool_or(contains(lower(t.text), name)) FILTER (WHERE t.s < 20000000 AND t.speaker <> 'system'), false) END AS named FROM turns t LEFT JOIN nm ON nm.key = t.key GROUP BY t.key""")
def win_named_early(spark, sf):
    t = tb.turns(spark, sf)
    names = tb.load(spark, sf, "conversations").where("role = 'system'").select(
        F.col("conv_id").alias("key"), normalized(F.regexp_extract("text", r"[\p{L}]+", 0)).alias("name"))
    keys = t.select("key").distinct().join(names, "key", "left")
    early = t.where((F.col("s") < 20 * tb.SECOND) & (F.col("speaker") != "system")).select("key", normalized(F.col("text")).alias("flat"))
    hit = spread_join(early, names, "key").groupBy("key").agg(F.bool_or(F.col("flat").contains(F.col("name"))).alias("hit"))
    return keys.join(hit, "key", "left").select("key", F.when(F.col("name").isNotNull(), F.coalesce("hit", F.lit(False))).alias("named"))


_WEEK = 7 * tb.DAY


@query("win_level_steps", f"""WITH {q.A}, l AS (SELECT key, s // {_WEEK} AS part, s, id, round(value / 400, 6) AS light FROM a),
 w AS (SELECT *, lag(id) OVER o AS pid, lag(light) OVER o AS p1, lag(light, 2) OVER o AS p2, lead(light) OVER o AS n1 FROM l WINDOW o AS (PARTITION BY key, part ORDER BY s, id)),
 m AS (SELECT key, part, quantile_cont(light, 0.5) AS typical FROM l GROUP BY 1, 2), z AS (SELECT w.*, abs(p1 - typical) > abs(light - typical) AS odd_before FROM w JOIN m ON w.key = m.key AND w.part = m.part)
 SELECT key, pid AS before, id AS after, CASE WHEN odd_before THEN pid ELSE id END AS odd, round(CASE WHEN odd_before THEN coalesce((p2 + light) / 2, light) ELSE coalesce((p1 + n1) / 2, p1) END, 9) AS target FROM z WHERE abs(light - p1) >= 0.12""")
def win_level_steps(spark, sf):
    l = tb.spans_a(spark, sf).select("key", F.expr(f"s div {_WEEK}").alias("part"), "s", "id", F.round(F.col("value") / 400, 6).alias("light"))
    keys, chunk = ["key", "part"], by_width("s", tb.CHUNK)
    w = cut_lineage(ordered_scan(l, keys, ["s", "id"], chunk, {"pid": prev(F.col("id")), "p1": prev(F.col("light")), "n1": nxt(F.col("light"))}))
    w = ordered_scan(w, keys, ["s", "id"], chunk, {"p2": prev(F.col("p1"))})
    typical = exact_quantiles(l, keys, "light", {"typical": 0.5}, 0.05)
    z = spread_join(w, typical, keys).where(F.abs(F.col("light") - F.col("p1")) >= 0.12)
    odd = F.abs(F.col("p1") - F.col("typical")) > F.abs(F.col("light") - F.col("typical"))
    target = F.when(odd, F.coalesce((F.col("p2") + F.col("light")) / 2, F.col("light"))).otherwise(F.coalesce((F.col("p1") + F.col("n1")) / 2, F.col("p1")))
    return z.select("key", F.col("pid").alias("before"), F.col("id").alias("after"), F.when(odd, F.col("pid")).otherwise(F.col("id")).alias("odd"), F.round(target, 9).alias("target"))


@query("win_retakes")
def win_retakes(spark, sf):
    d = tb.load(spark, sf, "conversations").select(F.col("conv_id").alias("key"), "turn", F.lower(bare(F.col("text"))).alias("said"), F.col("text").rlike(r"[.!?]\s*$").alias("finished"))
    return sq.retakes(d, ["key"], "turn", "said", "finished").select("key", "turn", "takes", "kept")


@query("win_take_near_dups", """WITH t AS (SELECT doc_id AS id, n_chars, md5(lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g'))) AS h FROM documents), k AS (SELECT h, arg_min(id, (-n_chars, id)) AS kept, count(*) AS n FROM t GROUP BY h)
 SELECT id, kept, n AS copies FROM t JOIN k ON t.h = k.h WHERE n > 1""")
def win_take_near_dups(spark, sf):
    t = tb.load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars", F.md5(F.lower(bare(F.col("text")))).alias("h"))
    k = t.groupBy("h").agg(F.min_by("id", F.struct((-F.col("n_chars")).alias("l"), "id")).alias("kept"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return t.join(k, "h").select("id", "kept", "copies")


_SHORTEST, _LEAST = 1_500_000, 50_000
# Runs of wide characters (none beyond the third plane), as a class of characters takes them.
_WIDE = "".join(f"\\x{{{run[0]:x}}}-\\x{{{run[-1]:x}}}" for wide, run in (
    (wide, list(run)) for wide, run in groupby(range(0x40000), lambda n: unicodedata.east_asian_width(chr(n)) in "WF")) if wide)
_OF = "key, turn, sent"


def _any_of(texts) -> str:
    return "(" + ", ".join(f"'{x}'" for x in texts) + ")"


# Lines of a sentence from word a to before b; costs of all of them for every number of lines; the cheapest ways word by word and line by line,
# walked back from the end; then the lines of a turn one after the other, short ones joined.
@query("win_caption_chunk", f"""WITH RECURSIVE {q.WORDS},
 x AS (SELECT *, length(text) AS len, length(text) + length(regexp_replace(text, '[^{_WIDE}]', '', 'g')) AS wide, lag(e) OVER o AS pe, lag(text) OVER o AS pt FROM words WINDOW o AS (PARTITION BY key, turn ORDER BY ord)),
 y AS (SELECT *, sum(CASE WHEN pe IS NULL OR s - pe >= {sq.SENTENCE_PAUSE} OR right(pt, 1) IN {_any_of(sq.SENTENCE_ENDS)} THEN 1 ELSE 0 END) OVER (PARTITION BY key, turn ORDER BY ord) AS sent FROM x),
 w AS (SELECT *, row_number() OVER o - 1 AS n, sum(len + 1) OVER o AS c, sum(wide + 1) OVER o AS d, sum(wide + 1) OVER (PARTITION BY {_OF}) AS total, count(*) OVER (PARTITION BY {_OF}) AS m,
   least(greatest(s - pe, 0), {sq.LONGEST_PAUSE}) + CASE WHEN right(pt, 1) IN {_any_of(sq.CLOSERS)} THEN {sq.CLOSES} ELSE 0 END + CASE WHEN {" OR ".join(f"starts_with(text, '{x}')" for x in sq.OPENERS)} THEN {sq.OPENS} ELSE 0 END
   - CASE WHEN right(pt, 1) IN {_any_of(sq.NUMERALS)} THEN {sq.COUNTS} ELSE 0 END - CASE WHEN right(pt, 1) IN {_any_of(sq.BINDERS)} OR left(text, 1) IN {_any_of(sq.BINDERS)} THEN {sq.BINDS} ELSE 0 END AS edge FROM y WINDOW o AS (PARTITION BY {_OF} ORDER BY ord)),
 l AS (SELECT a.key, a.turn, a.sent, a.n AS a, b.n + 1 AS b, a.m, a.total, b.d - a.d + a.wide + 1 AS wide, CASE WHEN a.n > 0 THEN a.edge ELSE 0 END AS edge FROM w a JOIN w b ON a.key = b.key AND a.turn = b.turn AND a.sent = b.sent AND b.n >= a.n AND b.n < a.n + 42
   AND (b.n = a.n OR (b.c - a.c + a.len <= 42 AND b.d - a.d + a.wide <= 42 AND b.e - a.s <= 4000000))),
 far AS (SELECT {_OF}, a, max(b) AS b, any_value(m) AS m, any_value(total) AS total FROM l GROUP BY {_OF}, a),
 g AS (SELECT {_OF}, b, 1 AS k FROM far WHERE a = 0 UNION ALL SELECT g.key, g.turn, g.sent, far.b, k + 1 FROM g JOIN far ON far.key = g.key AND far.turn = g.turn AND far.sent = g.sent AND far.a = g.b),
 f AS (SELECT {_OF}, max(k) AS fewest FROM g GROUP BY {_OF}),
 nn AS (SELECT {_OF}, m, total, fewest, unnest(range(fewest, least(m, fewest + (fewest + 2) // 3) + 1)) AS n FROM f JOIN far USING ({_OF}) WHERE a = 0),
 cl AS (SELECT l.key, l.turn, l.sent, n, a, b, 1000000 * (n * wide - l.total) * (n * wide - l.total) - edge * l.total * l.total AS cost FROM l JOIN nn USING ({_OF})),
 dp AS (SELECT {_OF}, n, 0 AS k, 0::BIGINT AS b, 0::HUGEINT AS cost, -1::BIGINT AS back FROM nn UNION ALL
  SELECT dp.key, dp.turn, dp.sent, dp.n, dp.k + 1, cl.b, min(dp.cost + cl.cost), arg_min(cl.a, (dp.cost + cl.cost, -cl.a)) FROM dp JOIN cl ON cl.key = dp.key AND cl.turn = dp.turn AND cl.sent = dp.sent AND cl.n = dp.n AND cl.a = dp.b WHERE dp.k < dp.n GROUP BY dp.key, dp.turn, dp.sent, dp.n, dp.k, cl.b),
 pk AS (SELECT {_OF}, any_value(m) AS m, arg_min(n, (cost + {sq.ONE_MORE} * total * total * (n - fewest), n)) AS n FROM dp JOIN nn USING ({_OF}, n) WHERE k = n AND b = m GROUP BY {_OF}),
 bk AS (SELECT dp.key, dp.turn, dp.sent, dp.n, k, b, back FROM dp JOIN pk USING ({_OF}, n) WHERE k = dp.n AND b = m UNION ALL
  SELECT dp.key, dp.turn, dp.sent, dp.n, dp.k, dp.b, dp.back FROM bk JOIN dp ON dp.key = bk.key AND dp.turn = bk.turn AND dp.sent = bk.sent AND dp.n = bk.n AND dp.k = bk.k - 1 AND dp.b = bk.back WHERE bk.k > 1),
 p AS (SELECT bk.key, bk.turn, min(ord) AS o, min(s) AS s, max(e) AS e, string_agg(text, ' ' ORDER BY ord) AS text, sum(wide + 1) - 1 AS wide FROM bk JOIN w ON w.key = bk.key AND w.turn = bk.turn AND w.sent = bk.sent AND w.n >= back AND w.n < b GROUP BY bk.key, bk.turn, bk.sent, bk.b HAVING max(e) - min(s) > {_LEAST}),
 pn AS (SELECT key, turn, row_number() OVER (PARTITION BY key, turn ORDER BY o) AS i, {{'s': s, 'e': e, 'text': text, 'wide': wide}} AS z FROM p),
 st AS (SELECT key, turn, i, z AS cur, [z][:0] AS done FROM pn WHERE i = 1 UNION ALL
  SELECT key, turn, CASE WHEN does = 'behind' THEN i ELSE i + 1 END,
   CASE does WHEN 'ahead' THEN {{'s': cur.s, 'e': nx.e, 'text': cur.text || ' ' || nx.text, 'wide': cur.wide + 1 + nx.wide}} WHEN 'behind' THEN {{'s': done[-1].s, 'e': cur.e, 'text': done[-1].text || ' ' || cur.text, 'wide': done[-1].wide + 1 + cur.wide}} ELSE nx END,
   CASE does WHEN 'ahead' THEN done WHEN 'behind' THEN done[:-2] ELSE list_append(done, cur) END
  FROM (SELECT st.*, pn.z AS nx, CASE WHEN pn.z IS NULL OR cur.e - cur.s >= {_SHORTEST} OR pn.z.s >= cur.s + {_SHORTEST} THEN 'on'
    WHEN length(cur.text) + 1 + length(pn.z.text) <= 42 AND cur.wide + 1 + pn.z.wide <= 42 AND pn.z.e - cur.s <= 4000000 THEN 'ahead'
    WHEN len(done) > 0 AND length(done[-1].text) + 1 + length(cur.text) <= 42 AND done[-1].wide + 1 + cur.wide <= 42 AND cur.e - done[-1].s <= 4000000 THEN 'behind' ELSE 'on' END AS does
   FROM st LEFT JOIN pn ON pn.key = st.key AND pn.turn = st.turn AND pn.i = st.i + 1 WHERE cur IS NOT NULL)),
 ln AS (SELECT key, turn, generate_subscripts(done, 1) AS line, unnest(done) AS z FROM st WHERE cur IS NULL)
 SELECT key, turn, line, z.s AS s, z.e AS e, z.text AS text FROM ln""")
def win_caption_chunk(spark, sf):
    return sq.caption_lines(tb.words(spark, sf, only=("turn", "text")), ["key", "turn"], "ord", "text", "s", "e", 42, 4 * tb.SECOND, 21, _SHORTEST, _LEAST)


@query("win_on_grid")
def win_on_grid(spark, sf):
    a = tb.spans_a(spark, sf).select("key", F.expr(f"s div {_WEEK}").alias("plan"), "s", "id", ((F.col("e") - F.col("s")) / tb.HOUR).alias("length"), (F.col("kind") != "error").alias("may"))
    return sq.on_grid(a, ["key", "plan"], "s", "id", "length", "may", 1.0, 0.3).select("key", "id", F.round("shift", 6).alias("shift"), "stuck")


_SLOT, _ROOM = 10 * tb.HOUR, 3 * tb.HOUR


@query("win_slot_offers", f"""WITH RECURSIVE {q.AB}, {q.BC}, cd AS (SELECT bc.key, cs, ce, t, row_number() OVER (PARTITION BY bc.key, cs ORDER BY t) AS n FROM bc JOIN ev ON ev.key = bc.key AND t >= cs AND t < ce WHERE ce - cs >= {_SLOT} AND least({_SLOT}, ce - t) >= {_ROOM}),
 r AS (SELECT key, cs, ce, n, t AS last, true AS taken FROM cd WHERE n = 1 UNION ALL SELECT cd.key, cd.cs, cd.ce, cd.n, CASE WHEN t - last >= {_SLOT} THEN t ELSE last END, t - last >= {_SLOT} FROM r JOIN cd ON cd.key = r.key AND cd.cs = r.cs AND cd.n = r.n + 1)
 SELECT key, cs AS run, last AS at, least({_SLOT}, ce - last) AS room FROM r WHERE taken""")
def win_slot_offers(spark, sf):
    runs = cut_lineage(iv.coalesce_spans(tb.spans_b(spark, sf), ["key"], "bs", "be", "bid", tb.CHUNK).where(F.col("be") - F.col("bs") >= _SLOT))
    ev = tb.events(spark, sf).select("key", F.col("t").alias("at"))
    bounds = iv.point_join(ev, runs.drop("n"), ["key"], "at", ("bs", "be"), tb.BIN).withColumnRenamed("bs", "run")
    return sq.slot_offers(bounds, ["key"], "run", "at", "be", _SLOT, _ROOM, tb.CHUNK).select("key", "run", "at", "room")
