"""Queries of the jobs composed of the other operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as pr
from ..operators import intervals as iv
from ..operators import plans as pl_
from ..operators import rollup as ru
from ..operators import sequence as sq
from ..operators import slots as sl
from ..operators import voices as vo
from ..operators.ordered import by_width, nxt, ordered_scan, prev, row_number, running_sum
from ..session import cut_lineage
from ..sources import tables as tb
from . import q_windows as qw
from . import sqlbase as q
from .registry import ORACLE, QUERIES, query


_TL_LEAST = 4 * q.HOUR


def _md5_of(*columns: str) -> str:
    return "md5(" + " || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in columns) + ")"


@query("op_build_timeline", f"""WITH RECURSIVE {q.AB}, {q.BC},
 fl AS (SELECT key, min(t) AS b0, max(t) AS fin, max(value) >= 150 AS ha FROM ev GROUP BY key),
 sg AS (SELECT key, id, s, s + (e - s) // 2 AS e, 'said' AS text, id % 5 = 0 AS made_up FROM a WHERE kind = 'click'),
 dk AS (SELECT key, t AS ds, t + CAST(round(value * 300 * 1000000) AS BIGINT) AS de FROM ev WHERE kind = 'signup'),
 fz AS (SELECT key, t AS fs, t + CAST(round(value * 900 * 1000000) AS BIGINT) AS fe FROM ev WHERE kind = 'error'),
 tn AS (SELECT key, kind AS speaker, t AS ts, t + {24 * q.HOUR} AS te FROM ev WHERE kind IN ('view', 'purchase')),
 inp AS (SELECT 'asset' AS what, key, b0 AS a, fin AS b, ha::VARCHAR AS text FROM fl UNION ALL SELECT 'segment', key, s, e, id || '/' || made_up || '/' || text FROM sg
  UNION ALL SELECT 'silence', key, cs, ce, '' FROM bc UNION ALL SELECT 'scene', key, t, t, '' FROM ev WHERE kind = 'error' UNION ALL SELECT 'dark', key, ds, de, '' FROM dk
  UNION ALL SELECT 'frozen', key, fs, fe, '' FROM fz UNION ALL SELECT 'turn', key, ts, te, speaker FROM tn),
 hs AS (SELECT {_md5_of("what", "key", "a", "b", "text")} AS h FROM inp),
 fp AS (SELECT sha256('v1/' || count(*) || '/' || sum(('0x' || substr(h, 1, 8))::BIGINT) || '/' || sum(('0x' || substr(h, 9, 8))::BIGINT) || '/' || sum(('0x' || substr(h, 17, 8))::BIGINT)
  || '/' || sum(('0x' || substr(h, 25, 8))::BIGINT)) AS f FROM hs),
 sc AS (SELECT sg.key, id, greatest(coalesce(lag(sg.e) OVER (PARTITION BY sg.key ORDER BY s, id), b0), s) AS s, least(sg.e, fin) AS e, text, made_up, b0 FROM sg JOIN fl ON sg.key = fl.key),
 sd AS (SELECT * FROM sc WHERE e > s),
 gr AS (SELECT key, coalesce(lag(e) OVER (PARTITION BY key ORDER BY s, id), b0) AS gs, s AS ge FROM sd
  UNION ALL SELECT fl.key, coalesce(max(sd.e), any_value(fl.b0)), any_value(fin) FROM fl LEFT JOIN sd ON sd.key = fl.key GROUP BY fl.key),
 gp AS (SELECT * FROM gr WHERE ge - gs >= {_TL_LEAST}),
 cu AS (SELECT key, gs, ge, t, row_number() OVER (PARTITION BY key, gs ORDER BY t) AS rn FROM (SELECT DISTINCT gp.key, gs, ge, t FROM gp JOIN ev ON gp.key = ev.key AND kind = 'error' AND t > gs AND t < ge)),
 w AS (SELECT key, gs, ge, gs AS last, CAST(0 AS BIGINT) AS rn, true AS taken FROM gp UNION ALL
  SELECT w.key, w.gs, w.ge, CASE WHEN t - last >= {_TL_LEAST} AND w.ge - t >= {_TL_LEAST} THEN t ELSE last END, cu.rn, t - last >= {_TL_LEAST} AND w.ge - t >= {_TL_LEAST}
  FROM w JOIN cu ON cu.key = w.key AND cu.gs = w.gs AND cu.rn = w.rn + 1),
 st AS (SELECT key, s, e, text, made_up FROM sd UNION ALL SELECT key, last, coalesce(lead(last) OVER (PARTITION BY key, gs ORDER BY last), ge), '', false FROM w WHERE taken),
 cl AS (SELECT st.*, fin, ha, 'tl_' || substr(f, 1, 8) || ':u' || printf('%04d', row_number() OVER (ORDER BY st.key, s) - 1) AS id FROM st JOIN fl ON st.key = fl.key, fp),
 rw AS (SELECT key, 'black' AS what, ds AS ms, de AS me FROM dk UNION ALL SELECT key, 'frozen', fs, fe FROM fz),
 rm AS (SELECT *, max(me) OVER (PARTITION BY key, what ORDER BY ms, me ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rw),
 rg AS (SELECT *, sum(CASE WHEN reach IS NULL OR ms > reach THEN 1 ELSE 0 END) OVER (PARTITION BY key, what ORDER BY ms, me) AS grp FROM rm),
 mk AS (SELECT key, what, min(ms) AS ms, max(me) AS me FROM rg GROUP BY key, what, grp UNION ALL SELECT key, 'silence', cs, ce FROM bc),
 sh AS (SELECT id, what, sum(least(e, me) - greatest(s, ms)) AS held FROM cl JOIN mk ON cl.key = mk.key AND s < me AND ms < e GROUP BY id, what),
 sr AS (SELECT cl.id, {", ".join(f"round(least(1.0, coalesce(max(held) FILTER (what = '{w}'), 0)::DOUBLE / (any_value(e) - any_value(s))), 3) AS {w}" for w in ("silence", "black", "frozen"))}
  FROM cl LEFT JOIN sh ON cl.id = sh.id GROUP BY cl.id),
 hd AS (SELECT id, speaker, sum(least(e, te) - greatest(s, ts)) AS held FROM cl JOIN tn ON cl.key = tn.key AND s < te AND ts < e GROUP BY id, speaker),
 sp AS (SELECT id, CASE WHEN held::DOUBLE / sum(held) OVER (PARTITION BY id) >= 0.8 THEN speaker END AS speaker FROM hd QUALIFY row_number() OVER (PARTITION BY id ORDER BY held DESC, speaker) = 1),
 ri AS (SELECT id, max(least(s - cs, ce - cs)) AS v FROM cl JOIN bc ON cl.key = bc.key AND cs - 20000 <= s AND s <= ce + 20000 GROUP BY id),
 ro AS (SELECT id, max(least(ce - e, ce - cs)) AS v FROM cl JOIN bc ON cl.key = bc.key AND cs - 20000 <= e AND e <= ce + 20000 GROUP BY id),
 kd AS (SELECT cl.*, silence, black, frozen, CASE WHEN text <> '' AND NOT made_up AND (NOT ha OR silence < 0.9) THEN 'speech' WHEN black >= 0.5 OR frozen >= 0.5 THEN 'unusable'
  WHEN ha AND silence >= 0.9 THEN 'silence' ELSE 'ambient' END AS kind FROM cl JOIN sr ON cl.id = sr.id)
 SELECT kd.id, key, s, e, greatest(0, least(coalesce(ri.v, 0), s)) AS safe_in, greatest(0, least(coalesce(ro.v, 0), fin - e)) AS safe_out, kind, text, silence, black, frozen,
  CASE WHEN kind = 'speech' THEN speaker END AS speaker FROM kd LEFT JOIN ri ON kd.id = ri.id LEFT JOIN ro ON kd.id = ro.id LEFT JOIN sp ON kd.id = sp.id""")
def op_build_timeline(spark, sf):
    from ..operators.timeline import build_timeline
    ev = tb.events(spark, sf)
    a = tb.spans_a(spark, sf)
    segments = a.where("kind = 'click'").select("key", "id", "s", F.expr("s + (e - s) div 2").alias("e"), F.lit("said").alias("text"), (F.col("id") % 5 == 0).alias("made_up"))
    assets = ev.groupBy("key").agg(F.min("t").alias("begin"), F.max("t").alias("fin"), (F.max("value") >= 150).alias("has_audio"))
    silences = cut_lineage(iv.coalesce_spans(tb.spans_b(spark, sf), ["key"], "bs", "be", "bid", tb.CHUNK).select("key", F.col("bs").alias("qs"), F.col("be").alias("qe")))
    scenes = ev.where("kind = 'error'").select("key", F.col("t").alias("cut"))
    dark = ev.where("kind = 'signup'").select("key", F.col("t").alias("ds"), (F.col("t") + F.round(F.col("value") * 300 * tb.SECOND).cast("long")).alias("de"))
    frozen = ev.where("kind = 'error'").select("key", F.col("t").alias("fs"), (F.col("t") + F.round(F.col("value") * 900 * tb.SECOND).cast("long")).alias("fe"))
    turns = ev.where(F.col("kind").isin("view", "purchase")).select("key", F.col("kind").alias("speaker"), F.col("t").alias("ts"), (F.col("t") + tb.DAY).alias("te"))
    return build_timeline(assets, segments, silences, scenes, dark, frozen, turns, _TL_LEAST, tb.BIN, tb.CHUNK, "v1")


@query("op_join_voices", """WITH RECURSIVE v AS (SELECT vec_id AS id, CASE WHEN vec_id % 4 = 0 THEN vec_id ELSE -(vec_id // 3) - 1 END AS file, embedding::DOUBLE[] AS v,
  1.0::DOUBLE + vec_id % 7 AS seconds FROM embeddings),
 c AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY file) = 1 THEN 0.6 ELSE 0.45 END::DOUBLE AS reach FROM v),
 e AS (SELECT x.id AS a, y.id AS b FROM c x JOIN c y ON x.id <> y.id
  AND 1 - list_cosine_similarity(x.v, y.v) < CASE WHEN x.file = y.file THEN 0.3 ELSE greatest(x.reach, y.reach) END),
 w AS (SELECT id AS a, id AS b FROM v UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a),
 g AS (SELECT a AS id, min(b) AS grp FROM w GROUP BY a),
 x AS (SELECT grp, seconds, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM c JOIN g USING (id)),
 p AS (SELECT grp, list(m ORDER BY i) AS print FROM (SELECT grp, i, sum(x * seconds) / sum(seconds) AS m FROM x GROUP BY grp, i) GROUP BY grp),
 d AS (SELECT c.*, p.grp AS label, round(1 - list_cosine_similarity(v, print), 9) AS distance FROM c, p),
 n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, label) = 1),
 s AS (SELECT *, distance < reach AND (distance < 0.3 OR id = first(id) OVER (PARTITION BY file, label ORDER BY distance < reach DESC, seconds DESC, id)) AS stays FROM n)
 SELECT id AS vec_id, CASE WHEN stays THEN min(id) FILTER (stays) OVER (PARTITION BY label) ELSE id END AS label, round(CASE WHEN stays THEN distance ELSE 0.0 END, 6) AS distance FROM s""")
def op_join_voices(spark, sf):
    e = tb.load(spark, sf, "embeddings").select("vec_id", "embedding", F.expr("IF(vec_id % 4 = 0, vec_id, -(vec_id div 3) - 1)").alias("file"), F.expr("1.0D + vec_id % 7").alias("seconds"))
    return vo.join_voices(e, "vec_id", "file", "embedding", "seconds")


_DAY = 24 * q.HOUR
_SECT = f"""ix AS (SELECT key, id, kind, s // {_DAY} AS day, row_number() OVER (PARTITION BY key ORDER BY s, id) AS i FROM a),
 se AS (SELECT key, day, min(i) AS first, max(i) AS last FROM ix GROUP BY 1, 2 HAVING max(CASE WHEN kind = 'view' THEN 0 ELSE 1 END) = 1), tt AS (SELECT key, count(*) AS n FROM ix GROUP BY key),
 wb AS (SELECT *, coalesce(lag(last) OVER (PARTITION BY key ORDER BY first), 0) + 1 AS want FROM se)"""


@query("op_section_check", f"""WITH {q.A}, {_SECT} SELECT key, first AS "at", 'does not follow on' AS problem FROM wb WHERE first <> want
 UNION ALL SELECT wb.key, first, 'not offered' FROM wb JOIN ix ON ix.key = wb.key AND ix.i = wb.first WHERE first > 1 AND first = want AND ix.kind = 'error'
 UNION ALL SELECT tt.key, coalesce(l, 0) + 1, 'left over' FROM tt LEFT JOIN (SELECT key, max(last) AS l FROM se GROUP BY key) x ON x.key = tt.key WHERE coalesce(l, 0) < n""")
def op_section_check(spark, sf):
    ix = cut_lineage(sq.numbered(tb.spans_a(spark, sf), ["key"], ["s", "id"], by_width("s", tb.CHUNK)))
    se = ix.groupBy("key", F.expr(f"s div {_DAY}").alias("day")).agg(
        F.min("i").alias("first"), F.max("i").alias("last"), F.max((F.col("kind") != "view").cast("int")).alias("k")).where("k = 1")
    cands = ix.where("kind <> 'error'").select("key", F.col("i").alias("at"))
    return pl_.section_problems(se, ix.groupBy("key").agg(F.count(F.lit(1)).alias("n")), cands, "key", "first", "last")


_ROLES = {"problem": ["the", "que"], "product": ["and"], "proof": ["[0-9]+"], "cta": ["le", "in"]}


@query("op_slot_candidates", f"""WITH {q.TURNS}, c AS (SELECT key, turn, lower(text) AS t, e - s AS len FROM turns), n AS (SELECT *, coalesce(lag(t[-6:]) OVER w, '') AS b, coalesce(lead(t[1:6]) OVER w, '') AS a FROM c WINDOW w AS (PARTITION BY key ORDER BY turn)),
 j AS (SELECT *, CASE WHEN b = '' OR t = '' THEN b || t ELSE b || ' ' || t END AS l FROM n), k AS (SELECT key, turn, CASE WHEN a = '' OR l = '' THEN l || a ELSE l || ' ' || a END AS j, length(l) - length(t) AS f, length(l) AS p, t, len FROM j),
 m AS (SELECT key, turn, j, f, p, unnest(['problem', 'problem', 'product', 'cta', 'cta']) AS slot, unnest(['the', 'que', 'and', 'le', 'in']) AS m FROM k)
 SELECT DISTINCT key, turn, slot, m AS why FROM m WHERE contains(j, m) AND len(list_filter(range(1, CAST(length(j) AS BIGINT) + 1), lambda i: j[i:i + length(m) - 1] = m AND i - 1 < p AND i - 1 + length(m) > f AND (i = 1 OR NOT regexp_matches(j[i - 1:i - 1], '[a-z0-9]')) AND NOT regexp_matches(j[i + length(m):i + length(m)], '[a-z0-9]'))) > 0
 UNION ALL SELECT key, turn, 'hook', 'short line' FROM k WHERE t <> '' AND len <= 3000000 AND len(regexp_extract_all(t, '[a-z0-9]+')) >= 4""")
def op_slot_candidates(spark, sf):
    from ..functions.scalars import marker_pattern
    t = tb.turns(spark, sf).withColumn("t", F.lower("text"))
    marks = {k: [marker_pattern(m) for m in v if m.isalpha()] for k, v in _ROLES.items()}
    return sl.slot_candidates(t, ["key"], "turn", "t", "s", "e", {k: v for k, v in marks.items() if v}).select("key", "turn", "slot", "why")


@query("op_subset_cutdowns", """WITH RECURSIVE u AS (SELECT l_orderkey AS key, l_linenumber AS n, min(l_returnflag) AS role, max(l_quantity) AS sec FROM lineitem GROUP BY 1, 2),
 x AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY n) - 1 AS i, role, sec FROM u), c AS (SELECT key, count(*) AS n, bool_or(role = 'R') AS asks FROM x GROUP BY key),
 sb AS (SELECT key, asks, unnest(range(1, (1::BIGINT << n))) AS m FROM c), t AS (SELECT sb.key, m, asks, sum(sec) AS tot, bool_or(role = 'A') AS h, bool_or(role = 'N') AS p, bool_or(role = 'R') AS r FROM sb JOIN x ON x.key = sb.key AND (m >> i) & 1 = 1 GROUP BY 1, 2, 3),
 ok AS (SELECT * FROM t WHERE h AND p AND (NOT asks OR r))
 SELECT c.key, CASE WHEN c.n <= 12 THEN CAST(count(*) FILTER (WHERE tot BETWEEN 60 AND 90) AS INTEGER) END AS fits,
  CASE WHEN c.n <= 12 THEN min(tot) END AS shortest, CASE WHEN c.n <= 12 THEN max(tot) END AS longest, c.n > 12 AS too_many
  FROM c LEFT JOIN ok ON ok.key = c.key GROUP BY c.key, c.n""")
def op_subset_cutdowns(spark, sf):
    u = tb.load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("key"), "l_linenumber").agg(F.min("l_returnflag").alias("role"), F.max("l_quantity").alias("seconds"))
    plans = u.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "role", "seconds"))), lambda x: F.struct(
        x["role"].alias("role"), x["seconds"].alias("seconds"))).alias("items"))
    return pl_.subset_cutdowns(plans, "key", "items", 60, 90, ["A", "N"], "R")


_USES = """us AS (SELECT DISTINCT l_orderkey AS key, CAST(l_linenumber AS BIGINT) AS pos, l_returnflag AS fact, CASE WHEN l_linestatus = 'O' AND l_tax >= 0.02 THEN 'establishes' WHEN l_tax < 0.02 THEN 'ahead' ELSE 'requires' END AS use, l_linenumber = 1 AS hook FROM lineitem),
 nm AS (SELECT DISTINCT l_orderkey AS key, l_returnflag AS fact FROM lineitem WHERE l_discount < 0.08), fs AS (SELECT key, fact, min(pos) AS told FROM us WHERE use = 'establishes' GROUP BY 1, 2),
 ju AS (SELECT us.*, told, nm.key IS NULL AS unknown FROM us LEFT JOIN fs ON fs.key = us.key AND fs.fact = us.fact LEFT JOIN nm ON nm.key = us.key AND nm.fact = us.fact)"""


@query("op_dependency_order", f"""WITH {_USES} SELECT DISTINCT key, pos, fact, CASE WHEN unknown THEN 'unknown fact' WHEN use = 'requires' AND NOT hook AND (told IS NULL OR told >= pos) THEN 'relied on too early' ELSE 'already established' END AS problem FROM ju
  WHERE unknown OR (use = 'requires' AND NOT hook AND (told IS NULL OR told >= pos)) OR (use = 'ahead' AND told < pos)
 UNION ALL SELECT key, min(pos), fact, 'never established later' FROM ju WHERE (use = 'ahead' OR (use = 'requires' AND hook)) AND NOT unknown AND told IS NULL GROUP BY key, fact
 UNION ALL SELECT nm.key, NULL, nm.fact, 'nothing establishes it' FROM nm LEFT JOIN fs ON fs.key = nm.key AND fs.fact = nm.fact WHERE fs.key IS NULL""")
def op_dependency_order(spark, sf):
    li = tb.load(spark, sf, "lineitem")
    use = F.when((F.col("l_linestatus") == "O") & (F.col("l_tax") >= 0.02), "establishes").when(F.col("l_tax") < 0.02, "ahead").otherwise("requires")
    uses = li.select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").cast("long").alias("pos"), F.col("l_returnflag").alias("fact"), use.alias("use"), (F.col("l_linenumber") == 1).alias("hook")).distinct()
    named = li.where("l_discount < 0.08").select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("fact"))
    return pl_.dependency_problems(uses, named, "key")


@query("op_plan_rules", """SELECT l_orderkey AS plan, l_partkey AS item, 'no such clip' AS problem, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 40) GROUP BY 1, 2
 UNION ALL SELECT l_orderkey, CAST(l_linenumber AS BIGINT), 'chosen twice', count(*) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
 UNION ALL SELECT l_orderkey, l_partkey, 'outside its clip', count(*) FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > p_size GROUP BY 1, 2
 UNION ALL SELECT o_orderkey, NULL, 'plan without clips', 1 FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def op_plan_rules(spark, sf):
    li, part = tb.load(spark, sf, "lineitem"), tb.load(spark, sf, "part")
    pick = li.select(F.col("l_orderkey").alias("plan"), F.col("l_partkey").alias("item"), "l_linenumber", "l_quantity")
    n = F.count(F.lit(1)).alias("n")

    def said(df, text):
        return df.withColumn("problem", F.lit(text)).select("plan", "item", "problem", "n")
    clips = part.select(F.col("p_partkey").alias("item"), "p_size")
    # What keeps the rules is dropped before it is counted, so only problems are held.
    gone = said(pick.join(clips.where("p_size <= 40"), "item", "left_anti").groupBy("plan", "item").agg(n), "no such clip")
    twice = said(pick.groupBy("plan", F.col("l_linenumber").cast("long").alias("item")).agg(n).where("n > 1"), "chosen twice")
    out = said(pick.join(clips, "item").where("l_quantity > p_size").groupBy("plan", "item").agg(n), "outside its clip")
    empty = tb.load(spark, sf, "orders").select(F.col("o_orderkey").alias("plan")).join(pick.select("plan"), "plan", "left_anti").select(
        "plan", F.lit(None).cast("long").alias("item"), F.lit(1).cast("long").alias("n"))
    return gone.unionByName(twice).unionByName(out).unionByName(said(empty, "plan without clips"))


SEVERITY = ("bad_picture", "clipping", "repeated", "mid_speech")


@query("op_findings", f"""SELECT * FROM (SELECT 0 AS rank, 'bad_picture' AS "check", CAST(id AS VARCHAR) AS about FROM ({ORACLE['sp_avoid_bad']}) WHERE stuck
 UNION ALL SELECT 1, 'clipping', CAST(id AS VARCHAR) FROM ({ORACLE['flt_clipping']}) UNION ALL SELECT 2, 'repeated', first || '/' || second FROM ({ORACLE['jn_self_repeat']})
 UNION ALL SELECT 3, 'mid_speech', CAST(pid AS VARCHAR) FROM ({ORACLE['jn_point_in_span']}) WHERE bid IS NOT NULL)""")
def op_findings(spark, sf):
    def one(key, name, about, where="true"):
        return QUERIES[key](spark, sf).where(where).select(F.lit(name).alias("check"), F.expr(about).alias("about"))
    found = one("sp_avoid_bad", "bad_picture", "cast(id as string)", "stuck").unionByName(
        one("flt_clipping", "clipping", "cast(id as string)")).unionByName(
        one("jn_self_repeat", "repeated", "concat(first, '/', second)")).unionByName(
        one("jn_point_in_span", "mid_speech", "cast(pid as string)", "bid is not null"))
    rank = F.lit(None).cast("int")
    for n, name in enumerate(SEVERITY):
        rank = F.when(F.col("check") == name, n).otherwise(rank)
    return found.select(rank.alias("rank"), "check", "about").orderBy("rank", "about")


_MID = f"""sd AS (SELECT key, id AS sid, t AS ss, t + CAST(round(value * 60 * 1000000) AS BIGINT) AS se FROM ev WHERE kind IN ('click', 'signup')),
 z AS (SELECT p.*, EXISTS (SELECT 1 FROM sd WHERE sd.key = p.key AND ss <= t AND t <= se) AS quiet, EXISTS (SELECT 1 FROM b WHERE b.key = p.key AND bs < t AND t < be) AS inside, (SELECT max(se) FROM sd WHERE sd.key = p.key AND se < t) AS rise FROM p)"""


@query("op_mid_span_cuts", f"""WITH {q.B}, {q.P_ONLY}, {_MID} SELECT key, pid, CASE WHEN inside THEN 'inside talk' ELSE 'bitten sound' END AS why, CASE WHEN NOT inside THEN t - rise END AS off_us FROM z
 WHERE NOT quiet AND (inside OR t - rise BETWEEN {60 * q.SECOND} AND {2 * q.HOUR})""")
def op_mid_span_cuts(spark, sf):
    p, ev = cut_lineage(tb.moments(spark, sf)), tb.events(spark, sf)
    sd = ev.where(F.col("kind").isin("click", "signup")).select("key", F.col("t").alias("ss"), (F.col("t") + F.round(F.col("value") * 60 * tb.SECOND).cast("long")).alias("se"))
    quiet = iv.point_join(p, sd, ["key"], "t", ("ss", "se"), tb.BIN, edges="[]").select("pid")
    inside = iv.point_join(p, tb.spans_b(spark, sf), ["key"], "t", ("bs", "be"), tb.BIN, edges="()").select("pid").distinct().withColumn("inside", F.lit(True))
    loud = p.join(quiet, "pid", "left_anti")
    rise = iv.asof(loud, sd.select("key", "se"), ["key"], "t", "se", "pid", tb.CHUNK, tolerance=-1, name="rise")
    j = rise.join(inside, "pid", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    off = F.col("t") - F.col("rise")
    return j.where(F.col("inside") | off.between(60 * tb.SECOND, 2 * tb.HOUR)).select(
        "key", "pid", F.when(F.col("inside"), "inside talk").otherwise("bitten sound").alias("why"), F.when(~F.col("inside"), off).alias("off_us"))


_MOM = """mo AS (SELECT key, tl AS m, 'cut:' || kind AS name, CASE WHEN speed <> lag(speed) OVER w THEN 'speed' ELSE '' END AS marks, id FROM pl WINDOW w AS (PARTITION BY key ORDER BY pos) QUALIFY lag(id) OVER w IS NOT NULL
 UNION ALL SELECT key, tl, 'words:' || CAST(floor(value / 100) AS INTEGER), '', id FROM pl WHERE kind = 'error' UNION ALL SELECT key, tl, 'broll:purchase', '', id FROM pl WHERE kind = 'purchase')"""


@query("op_event_moments", f"""WITH {q.PLACED}, {_MOM}, n AS (SELECT *, row_number() OVER (PARTITION BY key, name ORDER BY m, id) AS k FROM mo)
 SELECT key, m AS at_us, CASE WHEN k = 1 THEN name ELSE name || '#' || k END AS moment, marks FROM n""")
def op_event_moments(spark, sf):
    pl = cut_lineage(tb.placements(spark, sf))
    cuts = ordered_scan(pl, ["key"], ["pos"], by_width("pos", sq.BLOCK), {"ps": prev(F.col("speed"))}).where("ps is not null").select(
        "key", "tl", F.concat(F.lit("cut:"), "kind").alias("name"), F.when(F.col("speed") != F.col("ps"), "speed").otherwise("").alias("marks"), "id")
    words = pl.where("kind = 'error'").select("key", "tl", F.concat(F.lit("words:"), F.floor(F.col("value") / 100).cast("string")).alias("name"), F.lit("").alias("marks"), "id")
    broll = pl.where("kind = 'purchase'").select("key", "tl", F.lit("broll:purchase").alias("name"), F.lit("").alias("marks"), "id")
    every = cuts.unionByName(words).unionByName(broll)
    return pl_.with_repeats(every, ["key"], "name", ["tl", "id"], by_width("tl", tb.CHUNK), "moment").select("key", F.col("tl").alias("at_us"), "moment", "marks")


@query("op_structure_rules", """WITH b AS (SELECT conv_id AS key, turn, role FROM conversations), c AS (SELECT key, count(*) FILTER (WHERE role = 'system') AS sy, count(*) FILTER (WHERE role = 'user') AS us, count(*) FILTER (WHERE role = 'assistant') AS a, arg_max(role, turn) AS fin, arg_min(role, turn) AS st FROM b GROUP BY key),
 r AS (SELECT *, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS k FROM b), m AS (SELECT *, max(k) OVER (PARTITION BY key ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM r)
 SELECT key, 'no system' AS problem FROM c WHERE sy = 0 UNION ALL SELECT key, 'no user' FROM c WHERE us = 0 UNION ALL SELECT key, 'too few user' FROM c WHERE us = 1 UNION ALL SELECT key, 'wrong ending' FROM c WHERE fin <> 'assistant'
 UNION ALL SELECT key, 'system not first' FROM c WHERE sy > 0 AND st <> 'system' UNION ALL SELECT DISTINCT key, 'out of order' FROM m WHERE k < top""")
def op_structure_rules(spark, sf):
    b = tb.load(spark, sf, "conversations").select(F.col("conv_id").alias("key"), "turn", "role")
    return pl_.structure_problems(b, "key", "turn", "role", {"system": 0, "user": 1, "assistant": 2}, {"system": 1, "user": 2}, ["assistant"], "system")


@query("op_credits", """SELECT DISTINCT l_orderkey AS project, 'Music: ' || s_name || ' (' || n_name || ')' AS credit FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0""")
def op_credits(spark, sf):
    uses = tb.load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("project"), "l_suppkey").distinct()
    lines = tb.load(spark, sf, "supplier").where("s_acctbal > 0").join(tb.load(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.col("s_suppkey").alias("l_suppkey"), F.format_string("Music: %s (%s)", "s_name", "n_name").alias("credit"))
    return uses.join(lines, "l_suppkey").select("project", "credit").distinct()


@query("op_read_script", f"""WITH {q.PLACED}, {q.B_ONLY} SELECT pl.key, pl.id, pos, tl, string_agg(CAST(bid AS VARCHAR), ' ' ORDER BY bs, bid) AS words FROM pl LEFT JOIN b ON b.key = pl.key AND s <= (bs + be) // 2 AND (bs + be) // 2 < e GROUP BY ALL""")
def op_read_script(spark, sf):
    pl = tb.placements(spark, sf).select("key", "id", "pos", "tl", "s", "e")
    b = tb.spans_b(spark, sf).withColumn("mid", F.expr("(bs + be) div 2"))
    hit = iv.point_join(b, pl.select("key", "id", "s", "e"), ["key"], "mid", ("s", "e"), tb.BIN)
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bs", "bid"))), lambda x: x["bid"].cast("string")), " ")
    return pl.join(hit.groupBy("id").agg(words.alias("words")), "id", "left").select("key", "id", "pos", "tl", "words")


@query("op_nominate", f"""WITH {q.EV}, {qw._SHOTS}, {qw._RET}, d AS (SELECT key, i, moment, lag(moment) OVER w AS bm, lag(i) OVER w AS bi FROM sx WHERE moment IS NOT NULL WINDOW w AS (PARTITION BY key ORDER BY i)),
 al AS (SELECT key, i AS pos, 'back_in_time:' || bi || '>' || i AS name FROM d WHERE bm - moment > {20 * tb.DAY} UNION ALL SELECT key, f, 'topic_returns:' || topic FROM ry WHERE pr IS NOT NULL
  UNION ALL SELECT key, min(i) FILTER (WHERE topic = 'purchase'), 'late_subject' FROM sx GROUP BY key HAVING min(i) FILTER (WHERE topic = 'purchase') > 5),
 n AS (SELECT *, row_number() OVER (PARTITION BY key, name ORDER BY pos) AS k FROM al)
 SELECT key, pos, CASE WHEN k = 1 THEN name ELSE name || '#' || k END AS doubt, CAST(NULL AS BIGINT) AS unchecked FROM n UNION ALL SELECT key, NULL, 'back_in_time', count(*) FROM sx WHERE moment IS NULL GROUP BY key""")
def op_nominate(spark, sf):
    shots = qw._shots(spark, sf)
    from ..operators.ordered import last_value
    dated = F.when(F.col("moment").isNotNull(), F.struct("moment", "i"))
    d = ordered_scan(shots, ["key"], ["i"], by_width("i", sq.BLOCK), {"b": last_value(dated, inclusive=False)})
    back = d.where(F.col("b.moment") - F.col("moment") > 20 * tb.DAY).select("key", F.col("i").alias("pos"), F.concat(
        F.lit("back_in_time:"), F.col("b.i").cast("string"), F.lit(">"), F.col("i").cast("string")).alias("name"))
    ret = sq.topic_returns(shots.withColumn("topic", F.when(F.col("topic") != "error", F.col("topic"))), ["key"], "i", "topic").select(
        "key", F.col("back_at").alias("pos"), F.concat(F.lit("topic_returns:"), "topic").alias("name"))
    late = shots.where("topic = 'purchase'").groupBy("key").agg(F.min("i").alias("pos")).where("pos > 5").select("key", "pos", F.lit("late_subject").alias("name"))
    every = cut_lineage(back.unionByName(ret).unionByName(late))
    named = pl_.with_repeats(every, ["key"], "name", ["pos"], by_width("pos", sq.BLOCK), "doubt").select("key", "pos", "doubt", F.lit(None).cast("long").alias("unchecked"))
    undated = shots.where("moment is null").groupBy("key").agg(F.count(F.lit(1)).alias("unchecked")).select("key", F.lit(None).cast("long").alias("pos"), F.lit("back_in_time").alias("doubt"), "unchecked")
    return named.unionByName(undated)


_RIGHT = """g AS (SELECT *, max(tle) OVER (PARTITION BY key, kind ORDER BY tl, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM pl),
 h AS (SELECT *, sum(CASE WHEN reach IS NULL OR tl > reach THEN 1 ELSE 0 END) OVER (PARTITION BY key, kind ORDER BY tl, id) AS grp FROM g),
 u AS (SELECT key, kind, min(tl) AS s, max(tle) AS e FROM h GROUP BY key, kind, grp), tk AS (SELECT key, kind, CAST(sum(tle - tl) AS BIGINT) AS talk FROM pl GROUP BY 1, 2), mn AS (SELECT key, arg_min(kind, (-talk, kind)) AS main FROM tk GROUP BY key)"""


@query("op_rights_facts", f"""WITH {q.PLACED}, {_RIGHT} SELECT u.key, u.kind, s, e, CASE WHEN u.kind = 'purchase' THEN 'licence: nobody has said' WHEN u.kind = 'signup' THEN 'licence: CC BY' END AS licence, u.kind <> main AS other_voice, talk
 FROM u JOIN tk ON tk.key = u.key AND tk.kind = u.kind JOIN mn ON mn.key = u.key""")
def op_rights_facts(spark, sf):
    pl = cut_lineage(tb.placements(spark, sf))
    u = iv.coalesce_spans(pl, ["key", "kind"], "tl", "tle", "id", tb.CHUNK).drop("n")
    talk = pl.groupBy("key", "kind").agg(F.sum(F.col("tle") - F.col("tl")).alias("talk"))
    main = talk.groupBy("key").agg(F.min(F.struct((-F.col("talk")).alias("t"), "kind")).alias("m")).select("key", F.col("m.kind").alias("main"))
    # What is known of each kind of sound: a fixed list.
    known = spark.createDataFrame([("purchase", "licence: nobody has said"), ("signup", "licence: CC BY")], "kind string, licence string")
    return u.join(talk, ["key", "kind"]).join(main, "key").join(F.broadcast(known), "kind", "left").select(
        "key", "kind", F.col("tl").alias("s"), F.col("tle").alias("e"), "licence", (F.col("kind") != F.col("main")).alias("other_voice"), "talk")


@query("op_cut_signals", f"""WITH {q.B}, {q.P_ONLY}, {q.BC}, l AS (SELECT p.pid, avg(pow(10, value / 100)) FILTER (WHERE ev.t < p.t) AS x, avg(pow(10, value / 100)) FILTER (WHERE ev.t >= p.t) AS y FROM p JOIN ev ON ev.key = p.key AND ev.t >= p.t - {_DAY} AND ev.t < p.t + {_DAY} GROUP BY p.pid)
 SELECT p.key, p.pid, EXISTS (SELECT 1 FROM b WHERE b.key = p.key AND bs < p.t AND p.t < be) AS in_word, EXISTS (SELECT 1 FROM bc WHERE bc.key = p.key AND cs < p.t AND p.t < ce) AS in_sentence,
 coalesce(abs(10 * log10(y) - 10 * log10(x)) >= 6, false) AS jump FROM p LEFT JOIN l ON l.pid = p.pid""")
def op_cut_signals(spark, sf):
    p, ev = cut_lineage(tb.moments(spark, sf)), tb.events(spark, sf)
    b = cut_lineage(tb.spans_b(spark, sf))
    union = iv.coalesce_spans(b, ["key"], "bs", "be", "bid", tb.CHUNK)

    def inside(spans, name):
        return iv.point_join(p, spans.select("key", "bs", "be"), ["key"], "t", ("bs", "be"), tb.BIN, edges="()").select("pid").distinct().withColumn(name, F.lit(True))
    near = p.select("key", "pid", F.col("t").alias("at"), (F.col("t") - _DAY).alias("w0"), (F.col("t") + _DAY).alias("w1"))
    around = iv.point_join(ev.select("key", "t", "value"), near, ["key"], "t", ("w0", "w1"), 2 * _DAY)
    e = F.pow(F.lit(10.0), F.col("value") / 100)
    lv = around.groupBy("pid").agg(F.avg(F.when(F.col("t") < F.col("at"), e)).alias("x"), F.avg(F.when(F.col("t") >= F.col("at"), e)).alias("y"))
    j = p.join(inside(b, "w"), "pid", "left").join(inside(union, "s"), "pid", "left").join(lv, "pid", "left")
    no = F.lit(False)
    return j.select("key", "pid", F.coalesce("w", no).alias("in_word"), F.coalesce("s", no).alias("in_sentence"),
                    F.coalesce(F.abs(10 * F.log10("y") - 10 * F.log10("x")) >= 6, no).alias("jump"))


@query("op_baseline_cut", f"""WITH {q.B}, {q.BC}, f AS (SELECT key, min(t) AS b0, max(t) AS fin FROM ev GROUP BY key), g AS (SELECT bc.key, coalesce(lag(ce) OVER (PARTITION BY bc.key ORDER BY cs), b0) AS s, cs AS e FROM bc JOIN f ON f.key = bc.key
  UNION ALL SELECT f.key, coalesce(max(ce), any_value(b0)), any_value(fin) FROM f LEFT JOIN bc ON bc.key = f.key GROUP BY f.key),
 k AS (SELECT * FROM g WHERE e - s >= {q.HOUR}), r AS (SELECT *, coalesce(sum(e - s) OVER (PARTITION BY key ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM k)
 SELECT key, s, CAST(least(e - s, {100 * q.HOUR} - used) AS BIGINT) AS len FROM r WHERE used < {100 * q.HOUR}""")
def op_baseline_cut(spark, sf):
    f = tb.events(spark, sf).groupBy("key").agg(F.min("t").alias("b0"), F.max("t").alias("fin"))
    union = cut_lineage(iv.coalesce_spans(tb.spans_b(spark, sf), ["key"], "bs", "be", "bid", tb.CHUNK))
    between = ordered_scan(union, ["key"], ["bs"], by_width("bs", tb.CHUNK), {"pe": prev(F.col("be"))}).join(f, "key").select(
        "key", F.coalesce("pe", "b0").alias("s"), F.col("bs").alias("e"))
    tail = f.join(union.groupBy("key").agg(F.max("be").alias("last")), "key", "left").select("key", F.coalesce("last", "b0").alias("s"), F.col("fin").alias("e"))
    k = between.unionByName(tail).where(F.col("e") - F.col("s") >= tb.HOUR)
    r = ordered_scan(k, ["key"], ["s"], by_width("s", tb.CHUNK), {"used": running_sum(F.col("e") - F.col("s"), inclusive=False)})
    return r.where(F.col("used") < 100 * tb.HOUR).select("key", "s", F.least(F.col("e") - F.col("s"), F.lit(100 * tb.HOUR) - F.col("used")).alias("len"))


@query("op_embed_refresh", """WITH c AS (SELECT conv_id AS key, turn, role, coalesce(lag(text) OVER w, '') || chr(10) || text || chr(10) || coalesce(lead(text) OVER w, '') AS x FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), d AS (SELECT key, turn, role, sha1('m1' || chr(10) || x) AS digest, len(regexp_extract_all(lower(x), '[\\p{L}\\p{N}]+'))::DOUBLE AS words FROM c)
 SELECT key, turn, digest, words, 'compute' AS what FROM d WHERE role <> 'user' UNION ALL SELECT -key - 1, turn, NULL, NULL, 'drop' FROM d WHERE role = 'system'""")
def op_embed_refresh(spark, sf):
    from pyspark.ml.functions import vector_to_array
    c = tb.load(spark, sf, "conversations").select(F.col("conv_id").alias("key"), "turn", "role", "text")
    seen = ordered_scan(c, ["key"], ["turn"], by_width("turn", 10_000), {"b": prev(F.col("text")), "a": nxt(F.col("text"))})
    blank = F.lit("")
    x = cut_lineage(seen.select("key", "turn", "role", F.concat(F.coalesce("b", blank), F.lit("\n"), "text", F.lit("\n"), F.coalesce("a", blank)).alias("x")))
    # Stored so far: the users' lines as they are, others under an older model, and some whose line is gone.
    digest = F.when(F.col("role") == "user", F.sha1(F.concat(F.lit("m1\n"), "x"))).otherwise(F.sha1(F.concat(F.lit("m0\n"), "x")))
    stored = x.select("key", "turn", digest.alias("digest"))
    stored = stored.unionByName(x.where("role = 'system'").select((-F.col("key") - 1).alias("key"), "turn", F.lit("old").alias("digest")))
    todo, orphans = vo.refresh_vectors(x.drop("role"), stored, ["key", "turn"], "x", "m1")
    # A hashed vector counts every word once, so its parts add up to the words of the text.
    weight = F.aggregate(vector_to_array("vector"), F.lit(0.0), lambda s, v: s + v)
    return todo.select("key", "turn", "digest", weight.alias("words"), F.lit("compute").alias("what")).unionByName(
        orphans.select("key", "turn", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("double").alias("words"), F.lit("drop").alias("what")))


@query("op_folder_tree", """WITH RECURSIVE t AS (SELECT p_partkey AS id, CASE WHEN p_partkey >= 10 THEN p_partkey // 10 END AS parent FROM part), a AS (SELECT id, id AS root, 0::BIGINT AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.id, a.root, a.depth + 1 FROM a JOIN t ON t.parent = a.id)
 SELECT id, root, depth FROM a""")
def op_folder_tree(spark, sf):
    t = tb.load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.expr("CASE WHEN p_partkey >= 10 THEN p_partkey div 10 END").alias("parent"))
    return pl_.ancestors(t, "id", "parent")
