"""Queries of the span algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators.ordered import by_width, nxt, ordered_scan, prev, running_sum, spread_join
from ..sources import tables as tb
from ..session import cut_lineage
from . import sqlbase as q
from .registry import query


@query("sp_coalesce", f"WITH {q.B}, {q.BC} SELECT key, cs, ce, n FROM bc")
def sp_coalesce(spark, sf):
    b = tb.spans_b(spark, sf)
    return iv.coalesce_spans(b, ["key"], "bs", "be", "bid", tb.CHUNK).select(
        "key", F.col("bs").alias("cs"), F.col("be").alias("ce"), "n")


@query("sp_subtract", f"""WITH {q.AB}, {q.BC},
 g AS (SELECT key, cs, ce, lead(cs) OVER (PARTITION BY key ORDER BY cs) AS ns FROM bc),
 first AS (SELECT key, -9223372036854775807 AS gs, min(cs) AS ge FROM bc GROUP BY key),
 gaps AS (SELECT key, ce AS gs, coalesce(ns, 9223372036854775807) AS ge FROM g UNION ALL SELECT * FROM first
   UNION ALL SELECT DISTINCT key, -9223372036854775807, 9223372036854775807 FROM a WHERE key NOT IN (SELECT key FROM bc))
 SELECT a.key, a.id, greatest(a.s, gs) AS ps, least(a.e, ge) AS pe FROM a JOIN gaps ON a.key = gaps.key AND a.s < ge AND gs < a.e
 WHERE least(a.e, ge) > greatest(a.s, gs)""")
def sp_subtract(spark, sf):
    a = tb.spans_a(spark, sf).select("key", "id", "s", "e")
    return iv.subtract_spans(a, tb.spans_b(spark, sf), ["key"], ["id"], ("s", "e"), ("bs", "be"),
                             tb.BIN, tb.CHUNK, "bid").select("key", "id", "ps", "pe")


_RUNS = """r0 AS (SELECT *, bvalue > 50 AS dear FROM b), r1 AS (SELECT *, lag(dear) OVER w AS pd FROM r0 WINDOW w AS (PARTITION BY key ORDER BY bs, bid)),
 r2 AS (SELECT *, sum(CASE WHEN pd IS NULL OR pd <> dear THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY bs, bid) AS run FROM r1),
 r3 AS (SELECT *, max(be) OVER (PARTITION BY key, run ORDER BY bs, bid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r2),
 r4 AS (SELECT *, sum(CASE WHEN reach IS NULL OR bs - reach > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY key, run ORDER BY bs, bid) AS grp FROM r3)"""


@query("sp_coalesce_guarded", f"""WITH {q.B}, {_RUNS} SELECT key, min(bs) AS bs, max(be) AS be, count(*) AS n, arg_min(bid, (bs, bid)) AS first_id, arg_max(bid, (bs, bid)) AS last_id FROM r4 GROUP BY key, run, grp""")
def sp_coalesce_guarded(spark, sf):
    b = tb.spans_b(spark, sf).withColumn("dear", F.col("bvalue") > 50)
    runs = iv.islands(b, ["key"], ["bs", "bid"], by_width("bs", tb.CHUNK), {"__d": prev(F.col("dear"))},
                      F.col("dear") != F.col("__d"), "run")
    at = F.struct("bs", "bid")
    ends = [F.min_by("bid", at).alias("first_id"), F.max_by("bid", at).alias("last_id")]
    return iv.coalesce_spans(runs, ["key", "run"], "bs", "be", "bid", tb.CHUNK, tb.HOUR, extra=ends).select(
        "key", "bs", "be", "n", "first_id", "last_id")


_V = "v AS (SELECT key, s, e FROM a WHERE kind <> 'error')"
_LONG, _JOIN, _PAD = 72 * tb.HOUR, 10 * tb.HOUR, 2 * tb.HOUR


@query("sp_group_capped", f"""WITH RECURSIVE {q.A}, v AS (SELECT key, s, s + (e - s) // 2 AS e, row_number() OVER (PARTITION BY key ORDER BY s) AS rn FROM a),
 w AS (SELECT key, rn, s, e, s AS gs, 1 AS grp FROM v WHERE rn = 1 UNION ALL
  SELECT v.key, v.rn, v.s, v.e, CASE WHEN v.s - w.e <= {_JOIN} AND v.e - w.gs <= {_LONG} THEN w.gs ELSE v.s END,
   CASE WHEN v.s - w.e <= {_JOIN} AND v.e - w.gs <= {_LONG} THEN w.grp ELSE w.grp + 1 END FROM w JOIN v ON v.key = w.key AND v.rn = w.rn + 1),
 g AS (SELECT key, grp, min(s) AS gs, max(e) AS ge, count(*) AS n FROM w GROUP BY key, grp), fin AS (SELECT key, max(t) AS fin FROM ev GROUP BY key),
 x AS (SELECT g.*, lag(ge) OVER o AS pe, lead(gs) OVER o AS ns, fin FROM g JOIN fin ON g.key = fin.key WINDOW o AS (PARTITION BY g.key ORDER BY grp))
 SELECT key, CAST(grp AS BIGINT) AS grp, n, greatest(gs - {_PAD}, coalesce((pe + gs) // 2, 0)) AS ps, least(ge + {_PAD}, coalesce((ge + ns) // 2, fin), fin) AS pe FROM x""")
def sp_group_capped(spark, sf):
    v = tb.spans_a(spark, sf).select("key", "s", F.expr("s + (e - s) div 2").alias("e"))
    fin = tb.events(spark, sf).groupBy("key").agg(F.max("t").alias("fin"))
    return iv.group_capped(v, ["key"], "s", "e", _JOIN, _LONG, _PAD, fin, "fin", tb.CHUNK)


@query("sp_intersect", f"""WITH {q.AB} SELECT a.key, id, bid, greatest(s, bs) AS s, least(e, be) AS e FROM a JOIN b ON a.key = b.key AND least(e, be) - greatest(s, bs) > 50000""")
def sp_intersect(spark, sf):
    pairs = iv.overlap_join(tb.spans_a(spark, sf).select("key", "id", "s", "e"), tb.spans_b(spark, sf), ["key"], ("s", "e"), ("bs", "be"), tb.BIN)
    return pairs.where(iv.overlap_length("s", "e", "bs", "be") > 50_000).select(
        "key", "id", "bid", F.greatest("s", "bs").alias("s"), F.least("e", "be").alias("e"))


_LEAST = 4 * tb.HOUR
_GAPS = f"gp AS (SELECT key, ce AS gs, lead(cs) OVER (PARTITION BY key ORDER BY cs) AS ge FROM bc QUALIFY ge - gs >= {_LEAST})"


@query("sp_complement_split", f"""WITH RECURSIVE {q.B}, {q.BC}, {_GAPS},
 cu AS (SELECT gp.key, gs, ge, t, row_number() OVER (PARTITION BY gp.key, gs ORDER BY t) AS rn FROM gp JOIN ev ON gp.key = ev.key AND t > gs AND t < ge),
 w AS (SELECT key, gs, ge, gs AS last, CAST(0 AS BIGINT) AS rn, true AS taken FROM gp UNION ALL
  SELECT w.key, w.gs, w.ge, CASE WHEN t - last >= {_LEAST} AND w.ge - t >= {_LEAST} THEN t ELSE last END, cu.rn, t - last >= {_LEAST} AND w.ge - t >= {_LEAST} FROM w JOIN cu ON cu.key = w.key AND cu.gs = w.gs AND cu.rn = w.rn + 1)
 SELECT key, gs AS gap, last AS s, coalesce(lead(last) OVER (PARTITION BY key, gs ORDER BY last), ge) AS e FROM w WHERE taken""")
def sp_complement_split(spark, sf):
    union = iv.coalesce_spans(tb.spans_b(spark, sf), ["key"], "bs", "be", "bid", tb.CHUNK)
    gaps = ordered_scan(union, ["key"], ["bs"], by_width("bs", tb.CHUNK), {"ge": nxt(F.col("bs"))}).where(
        F.col("ge").isNotNull()).select("key", F.col("be").alias("gs"), "ge").withColumn("gap", F.col("gs"))
    cuts = tb.events(spark, sf).select("key", "t")
    return iv.split_gaps(gaps, cuts, ["key"], "gap", ("gs", "ge"), "t", _LEAST, tb.BIN, tb.CHUNK)


_SAID = "sd AS (SELECT key, id AS sid, t AS ss, t + CAST(round(value * 60 * 1000000) AS BIGINT) AS se FROM ev WHERE kind IN ('click', 'signup'))"
_INNER = f"""qt AS (SELECT key, id AS qid, s AS qs, e AS qe FROM a WHERE kind = 'view' AND e - s > {tb.HOUR}),
 ig AS (SELECT bc.key, cs, ce, qs, qe FROM bc JOIN qt ON bc.key = qt.key AND qs > cs AND qe < ce
 WHERE EXISTS (SELECT 1 FROM sd WHERE sd.key = bc.key AND ss < qs AND se > cs) AND EXISTS (SELECT 1 FROM sd WHERE sd.key = bc.key AND se > qe AND ss < ce)
 AND NOT EXISTS (SELECT 1 FROM sd WHERE sd.key = bc.key AND ss < (qs + qe) // 2 AND (qs + qe) // 2 < se))"""


def _inner(spark, sf):
    ev = tb.events(spark, sf)
    windows = iv.coalesce_spans(tb.spans_b(spark, sf), ["key"], "bs", "be", "bid", tb.CHUNK).select(
        "key", F.col("bs").alias("cs"), F.col("be").alias("ce")).withColumn("win", F.concat_ws("/", "key", "cs"))
    windows = cut_lineage(windows)
    quiet = tb.spans_a(spark, sf).where("kind = 'view'").select("key", F.col("s").alias("qs"), F.col("e").alias("qe"))
    said = ev.where(F.col("kind").isin("click", "signup")).select(
        "key", F.col("t").alias("ss"), (F.col("t") + F.round(F.col("value") * 60 * tb.SECOND).cast("long")).alias("se"))
    return windows, iv.inner_gaps(windows, quiet, said, ["key"], "win", ("cs", "ce"), ("qs", "qe"), ("ss", "se"), tb.HOUR, tb.BIN)


@query("sp_inner_gaps", f"WITH {q.AB}, {q.BC}, {_SAID}, {_INNER} SELECT key, cs, qs, qe FROM ig")
def sp_inner_gaps(spark, sf):
    return _inner(spark, sf)[1].select("key", "cs", "qs", "qe")


_BREATH = 10 * 60 * tb.SECOND


@query("sp_cut_out", f"""WITH {q.AB}, {q.BC}, {_SAID}, {_INNER}, ct AS (SELECT DISTINCT key, cs, ce, qs + {_BREATH} AS xs, qe - {_BREATH} AS xe FROM ig WHERE qe - qs - {2 * _BREATH} > {tb.HOUR // 6}),
 p AS (SELECT key, cs, ce, cs AS ps, xs AS pe, xs FROM ct), k AS (SELECT key, cs, ce, xs, xe, lag(xe) OVER w AS px, lead(xs) OVER w AS nx FROM ct WINDOW w AS (PARTITION BY key, cs ORDER BY xs))
 SELECT key, cs, coalesce(px, cs) AS ps, xs AS pe FROM k UNION ALL SELECT key, cs, xe, ce FROM k WHERE nx IS NULL
 UNION ALL SELECT key, cs, cs, ce FROM bc WHERE (key, cs) NOT IN (SELECT (key, cs) FROM ct)""")
def sp_cut_out(spark, sf):
    windows, gaps = _inner(spark, sf)
    gaps = cut_lineage(gaps)
    out = iv.cut_out(windows, gaps.select("key", "qs", "qe").distinct(), ["key"], "win", ("cs", "ce"), ("qs", "qe"), _BREATH, tb.HOUR // 6, tb.BIN, tb.CHUNK)
    return out.join(windows.select("win", "cs"), "win").select("key", "cs", "ps", "pe")


_SNAP = 2 * tb.HOUR


@query("sp_snap_edges", f"""WITH RECURSIVE {q.A}, w0 AS (SELECT key, id, s, e FROM a WHERE kind IN ('click', 'view', 'signup')),
 qt AS (SELECT key, t - 1800000000 AS qs, t + CAST(round(value * 30 * 1000000) AS BIGINT) AS qe FROM ev WHERE kind = 'error'),
 ac AS (SELECT w0.id, min(qs) AS q0, arg_max(qe, qs) AS q1 FROM w0 JOIN qt ON w0.key = qt.key AND s < qs AND qe < e GROUP BY w0.id),
 w1 AS (SELECT w0.key, w0.id, w0.s, w0.e, CASE WHEN q0 IS NOT NULL AND e - q1 >= q0 - s THEN q1 ELSE s END AS s1, CASE WHEN q0 IS NOT NULL AND e - q1 < q0 - s THEN q0 ELSE e END AS e1 FROM w0 LEFT JOIN ac ON w0.id = ac.id),
 o1 AS (SELECT w1.id, qe AS onset, row_number() OVER (PARTITION BY w1.id ORDER BY abs(qe - s1), qe) AS rn FROM w1 JOIN qt ON w1.key = qt.key),
 o2 AS (SELECT w1.id, qs AS offset_, row_number() OVER (PARTITION BY w1.id ORDER BY abs(qs - e1), qs) AS rn FROM w1 JOIN qt ON w1.key = qt.key),
 w2 AS (SELECT w1.*, CASE WHEN abs(onset - s1) <= {_SNAP} THEN onset END AS onset, CASE WHEN abs(offset_ - e1) <= {_SNAP} THEN offset_ END AS offs,
  lead(s1) OVER (PARTITION BY w1.key ORDER BY w1.s, w1.id) AS ns, row_number() OVER (PARTITION BY w1.key ORDER BY w1.s, w1.id) AS n FROM w1
  LEFT JOIN o1 ON w1.id = o1.id AND o1.rn = 1 LEFT JOIN o2 ON w1.id = o2.id AND o2.rn = 1),
 f0 AS (SELECT key, 0::BIGINT AS n, 0::BIGINT AS id, 0::BIGINT AS new_s, 0::BIGINT AS new_e FROM w2 GROUP BY key),
 f AS (SELECT * FROM f0 UNION ALL SELECT w2.key, w2.n, w2.id,
  CASE WHEN onset IS NOT NULL AND f.new_e <= onset AND onset < e1 THEN onset ELSE s1 END AS ns_,
  CASE WHEN offs IS NOT NULL AND (CASE WHEN onset IS NOT NULL AND f.new_e <= onset AND onset < e1 THEN onset ELSE s1 END) < offs AND (ns IS NULL OR offs <= ns) THEN offs ELSE e1 END
  FROM f JOIN w2 ON w2.key = f.key AND w2.n = f.n + 1)
 SELECT key, id, new_s, new_e FROM f WHERE n > 0""")
def sp_snap_edges(spark, sf):
    w = tb.spans_a(spark, sf).where(F.col("kind").isin("click", "view", "signup")).select("key", "id", "s", "e")
    quiet = tb.events(spark, sf).where("kind = 'error'").select(
        "key", (F.col("t") - 1800 * tb.SECOND).alias("qs"), (F.col("t") + F.round(F.col("value") * 30 * tb.SECOND).cast("long")).alias("qe"))
    return iv.snap_edges(w, quiet, ["key"], "id", ("s", "e"), ("qs", "qe"), _SNAP, tb.BIN, tb.CHUNK).select("key", "id", "new_s", "new_e")


@query("sp_trim_ends", f"""WITH {q.AB}, {q.BC}, ends AS (SELECT key, min(cs) AS hs, arg_min(ce, cs) AS he, max(cs) AS ls, arg_max(ce, cs) AS le FROM bc GROUP BY key),
 h AS (SELECT x.key, min(s) AS fw FROM ends x JOIN a ON a.key = x.key AND kind = 'click' AND s >= hs AND e <= he GROUP BY x.key),
 l AS (SELECT x.key, max(e) AS lw FROM ends x JOIN a ON a.key = x.key AND kind = 'click' AND s >= ls AND e <= le GROUP BY x.key)
 SELECT x.key, CASE WHEN fw IS NULL THEN hs ELSE greatest(hs, least(fw - {_BREATH}, hs + {2 * tb.HOUR})) END AS opens,
 CASE WHEN lw IS NULL THEN le ELSE least(le, greatest(lw + {_BREATH}, le - {2 * tb.HOUR})) END AS closes FROM ends x LEFT JOIN h ON x.key = h.key LEFT JOIN l ON x.key = l.key""")
def sp_trim_ends(spark, sf):
    union = iv.coalesce_spans(tb.spans_b(spark, sf), ["key"], "bs", "be", "bid", tb.CHUNK)
    ends = union.groupBy("key").agg(F.min("bs").alias("hs"), F.min_by("be", "bs").alias("he"), F.max("bs").alias("ls"), F.max_by("be", "bs").alias("le"))
    w = spread_join(tb.spans_a(spark, sf).where("kind = 'click'").select("key", "s", "e"), ends, "key")
    inside = w.groupBy("key").agg(F.min(F.when((F.col("s") >= F.col("hs")) & (F.col("e") <= F.col("he")), F.col("s"))).alias("fw"),
                                  F.max(F.when((F.col("s") >= F.col("ls")) & (F.col("e") <= F.col("le")), F.col("e"))).alias("lw"))
    j = ends.join(inside, "key", "left")
    opens = F.when(F.col("fw").isNull(), F.col("hs")).otherwise(F.greatest("hs", F.least(F.col("fw") - _BREATH, F.col("hs") + 2 * tb.HOUR)))
    closes = F.when(F.col("lw").isNull(), F.col("le")).otherwise(F.least("le", F.greatest(F.col("lw") + _BREATH, F.col("le") - 2 * tb.HOUR)))
    return j.select("key", opens.alias("opens"), closes.alias("closes"))


_REACH = 6 * tb.HOUR


@query("sp_extend_edges", f"""WITH {q.AB}, {q.BC}, x AS (SELECT key, id, s, e FROM a WHERE kind = 'click'), w AS (SELECT key, s AS ws, e AS we FROM a WHERE kind = 'view'),
 k AS (SELECT x.*, EXISTS (SELECT 1 FROM bc WHERE bc.key = x.key AND cs - 20000 <= s AND s <= ce + 20000) AS qs, EXISTS (SELECT 1 FROM bc WHERE bc.key = x.key AND cs - 20000 <= e AND e <= ce + 20000) AS qe,
  (SELECT max(ce) FROM bc WHERE bc.key = x.key AND ce <= s) AS onset, (SELECT min(cs) FROM bc WHERE bc.key = x.key AND cs >= e) AS fall,
  (SELECT max(we) FROM w WHERE w.key = x.key AND we <= s + 20000) AS wb, (SELECT min(ws) FROM w WHERE w.key = x.key AND ws >= e - 20000) AS wa FROM x)
 SELECT key, id, CASE WHEN NOT qs AND s - onset <= {_REACH} AND s - onset >= 150000 THEN least(s, greatest(onset - {_BREATH}, coalesce(wb, 0))) ELSE s END AS new_s,
 CASE WHEN NOT qe AND fall - e <= {_REACH} AND fall - e >= 150000 THEN greatest(e, least(fall + {_BREATH}, coalesce(wa, 9223372036854775807))) ELSE e END AS new_e FROM k""")
def sp_extend_edges(spark, sf):
    from ..operators.edges import extend_to_sound
    a = tb.spans_a(spark, sf).select("key", "id", "kind", "s", "e")
    quiet = cut_lineage(iv.coalesce_spans(tb.spans_b(spark, sf), ["key"], "bs", "be", "bid", tb.CHUNK).select("key", "bs", "be"))
    words = a.where("kind = 'view'").select("key", F.col("s").alias("ws"), F.col("e").alias("we"))
    return extend_to_sound(a.where("kind = 'click'").drop("kind"), quiet, words, ["key"], "id", ("s", "e"), ("bs", "be"), ("ws", "we"),
                           _REACH, 150_000, _BREATH, tb.BIN, tb.CHUNK).select("key", "id", "new_s", "new_e")


@query("sp_avoid_bad", f"""WITH {q.AB}, {q.BC}, o AS (SELECT a.id, ce AS v, row_number() OVER (PARTITION BY a.id ORDER BY abs(y.ce - s), -y.ce) AS rn FROM a JOIN bc x ON a.key = x.key AND x.cs <= s AND s < x.ce JOIN bc y ON a.key = y.key AND abs(y.ce - s) <= {_REACH}),
 c AS (SELECT a.id, y.cs AS v, row_number() OVER (PARTITION BY a.id ORDER BY abs(y.cs - e), -y.cs) AS rn FROM a JOIN bc x ON a.key = x.key AND x.cs < e AND e <= x.ce JOIN bc y ON a.key = y.key AND abs(y.cs - e) <= {_REACH}),
 k AS (SELECT a.*, EXISTS (SELECT 1 FROM bc WHERE bc.key = a.key AND cs <= s AND s < ce) AS bads, EXISTS (SELECT 1 FROM bc WHERE bc.key = a.key AND cs < e AND e <= ce) AS bade, o.v AS os, c.v AS cs FROM a LEFT JOIN o ON a.id = o.id AND o.rn = 1 LEFT JOIN c ON a.id = c.id AND c.rn = 1),
 m AS (SELECT *, coalesce(os, s) AS ms, coalesce(cs, e) AS me, (bads AND os IS NULL) OR (bade AND cs IS NULL) AS st FROM k)
 SELECT key, id, CASE WHEN me <= ms THEN s ELSE ms END AS new_s, CASE WHEN me <= ms THEN e ELSE me END AS new_e, st OR (me <= ms AND (ms <> s OR me <> e)) AS stuck FROM m""".replace("SELECT a.id, ce AS v", "SELECT a.id, y.ce AS v"))
def sp_avoid_bad(spark, sf):
    bad = cut_lineage(iv.coalesce_spans(tb.spans_b(spark, sf), ["key"], "bs", "be", "bid", tb.CHUNK).drop("n"))
    return iv.avoid(tb.spans_a(spark, sf).select("key", "id", "s", "e"), bad, ["key"], "id", ("s", "e"), ("bs", "be"), _REACH, tb.BIN, tb.CHUNK).select(
        "key", "id", "new_s", "new_e", "stuck")


@query("sp_hold_min", f"""WITH {q.B}, d AS (SELECT key, max(t) AS room FROM ev GROUP BY key), n AS (SELECT *, lead(bs) OVER (PARTITION BY key ORDER BY bs, bid) AS ns FROM b)
 SELECT n.key, bid, CASE WHEN be - bs >= {4 * tb.HOUR} THEN be ELSE greatest(be, least(bs + {4 * tb.HOUR}, coalesce(ns, room), room)) END AS held FROM n JOIN d ON n.key = d.key""")
def sp_hold_min(spark, sf):
    room = tb.events(spark, sf).groupBy("key").agg(F.max("t").alias("room"))
    b = ordered_scan(tb.spans_b(spark, sf), ["key"], ["bs", "bid"], by_width("bs", tb.CHUNK), {"ns": nxt(F.col("bs"))})
    b = spread_join(b, room, "key")
    held = F.least(F.col("bs") + 4 * tb.HOUR, F.coalesce("ns", "room"), F.col("room"))
    return b.select("key", "bid", F.when(F.col("be") - F.col("bs") >= 4 * tb.HOUR, F.col("be")).otherwise(F.greatest("be", held)).alias("held"))


_SEGS = f"ws AS (SELECT key, id, kind, s, e, s // {tb.DAY} AS seg FROM a WHERE kind <> 'error'), sg AS (SELECT key, seg, min(s) AS gs, max(e) AS ge FROM ws GROUP BY key, seg)"


@query("sp_override", f"""WITH {q.AB}, {q.BC}, {_SEGS}, kept AS (SELECT key, seg, id, s, e FROM ws WHERE NOT EXISTS (SELECT 1 FROM bc WHERE bc.key = ws.key AND s < ce AND cs < e)),
 hw AS (SELECT ev.key, ev.id, t AS s, t + 60000000 AS e, t + 30000000 AS mid, cs, ce FROM ev JOIN bc ON ev.key = bc.key AND cs <= t + 30000000 AND t + 30000000 < ce WHERE kind = 'error'),
 pick AS (SELECT hw.key, hw.id, hw.s, hw.e, seg, row_number() OVER (PARTITION BY hw.id ORDER BY greatest(gs - mid, mid - ge, 0), gs) AS rn FROM hw JOIN sg ON hw.key = sg.key AND sg.gs < ce AND cs < sg.ge),
 allw AS (SELECT key, seg, id, s, e FROM kept UNION ALL SELECT key, seg, id, s, e FROM pick WHERE rn = 1)
 SELECT key, seg, min(s) AS s, max(e) AS e, count(*) AS words, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY s, id) AS text FROM allw GROUP BY key, seg""")
def sp_override(spark, sf):
    from ..operators.edges import override_words
    a = tb.spans_a(spark, sf).where("kind <> 'error'").select("key", F.expr(f"s div {tb.DAY}").alias("seg"), "id", "s", "e")
    fixed = iv.coalesce_spans(tb.spans_b(spark, sf), ["key"], "bs", "be", "bid", tb.CHUNK).select("key", F.col("bs").alias("cs"), F.col("be").alias("ce"))
    heard = tb.moments(spark, sf).select("key", F.col("pid").alias("id"), F.col("t").alias("s"), (F.col("t") + 60 * tb.SECOND).alias("e"))
    words = override_words(a, heard, fixed, ["key"], "seg", "id", ("s", "e"), ("cs", "ce"), tb.BIN)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "id"))), lambda w: w["id"].cast("string")), " ")
    return words.groupBy("key", "seg").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("words"), text.alias("text"))


@query("sp_running_starts", f"WITH {q.PLACED} SELECT pl.key, id, pos, tl, total FROM pl JOIN (SELECT key, max(tle) AS total FROM pl GROUP BY key) d ON pl.key = d.key")
def sp_running_starts(spark, sf):
    pl = tb.placements(spark, sf)
    return spread_join(pl, pl.groupBy("key").agg(F.max("tle").alias("total")), "key").select("key", "id", "pos", "tl", "total")


@query("sp_part_bounds", f"""WITH {q.PLACED} SELECT p.key, p.id, max(m.tl) AS part FROM pl p LEFT JOIN pl m ON m.key = p.key AND m.kind = 'signup' AND m.tl <= (p.tl + p.tle) // 2 GROUP BY p.key, p.id""")
def sp_part_bounds(spark, sf):
    pl = tb.placements(spark, sf)
    marks = pl.where("kind = 'signup'").select("key", F.col("tl").alias("m"))
    mids = pl.select("key", "id", F.expr("(tl + tle) div 2").alias("mid"))
    return iv.asof(mids, marks, ["key"], "mid", "m", "id", tb.CHUNK, name="part").select("key", "id", "part")
