"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators.ordered import by_width, nxt, ordered_scan, prev, running_sum, spread_join
from ..sources import tables as tb
from . import sqlbase as q
from .registry import query


@query("jn_interval_overlap", f"""WITH {q.AB} SELECT a.key, id, bid, least(e, be) - greatest(s, bs) AS overlap_us
 FROM a JOIN b ON a.key = b.key AND s < be AND bs < e""")
def jn_interval_overlap(spark, sf):
    a, b = tb.spans_a(spark, sf), tb.spans_b(spark, sf)
    return iv.overlap_join(a, b, ["key"], ("s", "e"), ("bs", "be"), tb.BIN).select(
        "key", "id", "bid", iv.overlap_length("s", "e", "bs", "be").alias("overlap_us"))


@query("jn_coverage_share", f"""WITH {q.AB}, o AS (SELECT id, sum(least(e, be) - greatest(s, bs)) AS c
 FROM a JOIN b ON a.key = b.key AND s < be AND bs < e GROUP BY id)
 SELECT key, a.id, CASE WHEN e <= s THEN 0.0::DOUBLE ELSE round(least(1.0::DOUBLE, coalesce(c, 0)::DOUBLE / (e - s)), 6) END AS share
 FROM a LEFT JOIN o ON a.id = o.id""")
def jn_coverage_share(spark, sf):
    a = tb.spans_a(spark, sf).select("key", "id", "s", "e")
    c = iv.covered(a, tb.spans_b(spark, sf), ["key"], ["id"], ("s", "e"), ("bs", "be"), tb.BIN)
    return c.select("key", "id", F.round(iv.share("covered", "s", "e"), 6).alias("share"))


@query("jn_point_in_span", f"""WITH {q.B}, {q.P_ONLY} SELECT p.key, pid, bid, be - t AS rest_us FROM p LEFT JOIN b
 ON p.key = b.key AND t > bs AND t < be""")
def jn_point_in_span(spark, sf):
    p, b = tb.moments(spark, sf), tb.spans_b(spark, sf)
    hit = iv.point_join(p, b, ["key"], "t", ("bs", "be"), tb.BIN, edges="()").select("pid", "bid", "be")
    return p.join(hit, "pid", "left").select("key", "pid", "bid", (F.col("be") - F.col("t")).alias("rest_us"))


@query("jn_asof_backward", f"""WITH {q.B}, {q.P_ONLY} SELECT p.key, pid, coalesce(max(be), 0) AS last_end FROM p LEFT JOIN b
 ON p.key = b.key AND be <= t + 20000 GROUP BY p.key, pid""")
def jn_asof_backward(spark, sf):
    p, b = tb.moments(spark, sf), tb.spans_b(spark, sf)
    got = iv.asof(p, b, ["key"], "t", "be", "pid", tb.CHUNK, tolerance=20_000)
    return got.select("key", "pid", F.coalesce("found", F.lit(0)).alias("last_end"))


@query("jn_asof_forward", f"""WITH {q.B}, {q.P_ONLY}, d AS (SELECT key, max(t) AS fin FROM ev GROUP BY key)
 SELECT p.key, pid, coalesce(min(bs), any_value(fin)) AS next_start FROM p JOIN d ON p.key = d.key LEFT JOIN b
 ON p.key = b.key AND bs >= t - 20000 GROUP BY p.key, pid""")
def jn_asof_forward(spark, sf):
    p, b = tb.moments(spark, sf), tb.spans_b(spark, sf)
    fin = tb.events(spark, sf).groupBy("key").agg(F.max("t").alias("fin"))
    got = iv.asof(p, b, ["key"], "t", "bs", "pid", tb.CHUNK, forward=True, tolerance=20_000)
    return spread_join(got, fin, "key").select("key", "pid", F.coalesce("found", "fin").alias("next_start"))


@query("jn_nearest_within", f"""WITH {q.B}, {q.P_ONLY}, m AS (SELECT DISTINCT key, x FROM (SELECT key, bs AS x FROM b UNION ALL SELECT key, be FROM b)),
 r AS (SELECT p.key, pid, x, row_number() OVER (PARTITION BY pid ORDER BY abs(x - t), -x) AS rn FROM p JOIN m ON p.key = m.key AND abs(x - t) <= {2 * q.HOUR})
 SELECT p.key, p.pid, x AS edge FROM p LEFT JOIN r ON p.pid = r.pid AND rn = 1""")
def jn_nearest_within(spark, sf):
    p, b = tb.moments(spark, sf), tb.spans_b(spark, sf)
    edges = b.select("key", F.explode(F.array("bs", "be")).alias("x"))
    return iv.nearest(p, edges, ["key"], "t", "x", "pid", 2 * tb.HOUR, tb.CHUNK, "edge").select("key", "pid", "edge")


_T = "tt AS (SELECT key, id AS tid, kind AS who, t AS ts, t + CAST(round(value * 600 * 1000000) AS BIGINT) AS te FROM ev)"


@query("jn_speaker_majority", f"""WITH {q.A}, {_T}, h AS (SELECT a.id, who, sum(least(e, te) - greatest(s, ts)) AS held FROM a JOIN tt ON a.key = tt.key AND s < te AND ts < e GROUP BY 1, 2),
 m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY held DESC, who) AS rn, sum(held) OVER (PARTITION BY id) AS spoken FROM h)
 SELECT a.key, a.id, CASE WHEN held::DOUBLE / spoken >= 0.8 THEN who END AS speaker FROM a LEFT JOIN m ON a.id = m.id AND rn = 1""")
def jn_speaker_majority(spark, sf):
    a = tb.spans_a(spark, sf).select("key", "id", "s", "e")
    ev = tb.events(spark, sf)
    turns = ev.select("key", F.col("kind").alias("speaker"), F.col("t").alias("ts"),
                      (F.col("t") + F.round(F.col("value") * 600 * tb.SECOND).cast("long")).alias("te"))
    return iv.majority(a, turns, ["key"], ["id"], ("s", "e"), ("ts", "te"), "speaker", tb.BIN).select("key", "id", "speaker")


@query("jn_headroom", f"""WITH {q.AB}, fin AS (SELECT key, max(t) AS fin FROM ev GROUP BY key),
 i AS (SELECT a.id, max(least(s - bs, be - bs)) AS v FROM a JOIN b ON a.key = b.key AND bs - 20000 <= s AND s <= be + 20000 GROUP BY 1),
 o AS (SELECT a.id, max(least(be - e, be - bs)) AS v FROM a JOIN b ON a.key = b.key AND bs - 20000 <= e AND e <= be + 20000 GROUP BY 1)
 SELECT a.key, a.id, greatest(0, least(coalesce(i.v, 0), s)) AS safe_in, greatest(0, least(coalesce(o.v, 0), fin - e)) AS safe_out
 FROM a JOIN fin ON a.key = fin.key LEFT JOIN i ON a.id = i.id LEFT JOIN o ON a.id = o.id""")
def jn_headroom(spark, sf):
    fin = tb.events(spark, sf).groupBy("key").agg(F.max("t").alias("fin"))
    a = spread_join(tb.spans_a(spark, sf).select("key", "id", "s", "e"), fin, "key")
    return iv.headroom(a, tb.spans_b(spark, sf), ["key"], ["id"], ("s", "e"), ("bs", "be"), "fin", tb.BIN).select(
        "key", "id", "safe_in", "safe_out")


@query("jn_midpoint_assign", f"""WITH {q.AB} SELECT b.key, bid, id FROM b LEFT JOIN a ON a.key = b.key AND s <= (bs + be) // 2 AND (bs + be) // 2 < e""")
def jn_midpoint_assign(spark, sf):
    b = tb.spans_b(spark, sf).withColumn("mid", F.expr("(bs + be) div 2"))
    hit = iv.point_join(b.select("key", "bid", "mid"), tb.spans_a(spark, sf).select("key", "id", "s", "e"), ["key"],
                        "mid", ("s", "e"), tb.BIN).select("bid", "id")
    return b.join(hit, "bid", "left").select("key", "bid", "id")


@query("jn_time_remap", f"""WITH {q.PLACED}, {q.B_ONLY} SELECT pl.key, id, bid, tl + (greatest(bs, s) - s) // speed AS o_start,
 tl + (least(be, e) - s) // speed AS o_end, bs < s OR be > e AS cut FROM pl JOIN b ON pl.key = b.key AND s < be AND bs < e""")
def jn_time_remap(spark, sf):
    pl = tb.placements(spark, sf).select("key", "id", "s", "e", "tl", "speed")
    return iv.remap(pl, tb.spans_b(spark, sf), ["key"], ("s", "e"), ("bs", "be"), "tl", "speed", tb.BIN).select(
        "key", "id", "bid", "o_start", "o_end", "cut")


@query("jn_anchor_relocate", f"""WITH {q.PLACED}, {q.P_ONLY}, v AS (SELECT * FROM pl WHERE kind <> 'error'),
 h AS (SELECT p.pid, v.id AS now_clip, v.tl + (p.t - v.s) // v.speed AS now_at, row_number() OVER (PARTITION BY p.pid ORDER BY CASE WHEN v.id = p.pid THEN 0 ELSE 1 END, v.tl, v.id) AS rn
 FROM p JOIN v ON p.key = v.key AND v.s - 20000 <= p.t AND p.t <= v.e + 20000)
 SELECT p.key, p.pid, now_clip, now_at, now_clip IS NULL AS gone FROM p LEFT JOIN h ON p.pid = h.pid AND rn = 1""")
def jn_anchor_relocate(spark, sf):
    now = tb.placements(spark, sf).where(F.col("kind") != "error").select("key", F.col("id").alias("clip"), "s", "e", "tl", "speed")
    notes = tb.moments(spark, sf).withColumn("anchor", F.col("pid"))
    return iv.relocate(notes, now, ["key"], "pid", "t", "anchor", "clip", ("s", "e"), "tl", "speed", tb.BIN).select(
        "key", "pid", "now_clip", "now_at", "gone")


@query("jn_self_repeat", f"""WITH {q.B} SELECT x.key, x.bid AS first, y.bid AS second, least(x.be, y.be) - greatest(x.bs, y.bs) AS shared
 FROM b x JOIN b y ON x.key = y.key AND (x.bs, x.bid) < (y.bs, y.bid) AND least(x.be, y.be) - greatest(x.bs, y.bs) >= {q.HOUR}""")
def jn_self_repeat(spark, sf):
    b = tb.spans_b(spark, sf).drop("bvalue")
    other = b.select("key", F.col("bid").alias("oid"), F.col("bs").alias("os"), F.col("be").alias("oe"))
    pairs = iv.overlap_join(b, other, ["key"], ("bs", "be"), ("os", "oe"), tb.BIN)
    shared = iv.overlap_length("bs", "be", "os", "oe")
    return pairs.where((F.struct("bs", "bid") < F.struct(F.col("os").alias("bs"), F.col("oid").alias("bid"))) & (shared >= tb.HOUR)).select(
        "key", F.col("bid").alias("first"), F.col("oid").alias("second"), shared.alias("shared"))


def _looks(spark, sf):
    e = tb.load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("key"), "embedding")
    bits = ["aggregate(sequence(0, 63), 0L, (a, i) -> a | shiftleft(IF(embedding[i] > {}, 1L, 0L), i))".format("0" if k == 0 else f"embedding[(i + {k}) % 64]") for k in range(3)]
    return e.select("id", "key", *[F.expr(b).alias(f"h{k}") for k, b in enumerate(bits)])


def _look_sql():
    def h(k):
        return "bit_count(xor(x.h{0}, y.h{0}))".format(k)
    bits = ", ".join("CAST(list_sum([CASE WHEN embedding[i] > {} THEN (1::HUGEINT << (i - 1)) ELSE 0::HUGEINT END for i in range(1, 65)]) AS UBIGINT) AS h{}".format(
        "0" if k == 0 else f"embedding[(i - 1 + {k}) % 64 + 1]", k) for k in range(3))
    return f"""WITH l AS (SELECT vec_id AS id, label AS key, {bits} FROM embeddings), c AS (SELECT *, min(id) OVER (PARTITION BY h0, h1, h2) AS class FROM l),
 d AS (SELECT least(x.class, y.class) AS first, greatest(x.class, y.class) AS second,
  list_sort([CAST({h(0)} AS INTEGER), CAST({h(1)} AS INTEGER), CAST({h(2)} AS INTEGER)])[2] AS bits, coalesce(x.key <> y.key, true) AS differ FROM c x JOIN c y ON x.id + 1 < y.id)
 SELECT 'alike' AS row, first, second, bits, count(*) AS pairs, count(*) FILTER (WHERE differ) AS apart FROM d WHERE bits <= 10 GROUP BY ALL
 UNION ALL SELECT 'member', class, id, 0, NULL, NULL FROM c"""


@query("jn_hash_similar", _look_sql())
def jn_hash_similar(spark, sf):
    from ..operators.similar import look_alikes, look_classes
    looks, hashes = _looks(spark, sf), ["h0", "h1", "h2"]
    alike = look_alikes(looks, "id", "key", "id", hashes, 10, every=True).select(F.lit("alike").alias("row"), "first", "second", "bits", "pairs", "apart")
    members = look_classes(looks, "id", hashes).select(F.lit("member").alias("row"), F.col("class").alias("first"), F.col("id").alias("second"), F.lit(0).alias("bits"), F.lit(None).cast("long").alias("pairs"), F.lit(None).cast("long").alias("apart"))
    return alike.unionByName(members)


@query("jn_greedy_match", None)
def jn_greedy_match(spark, sf):
    from ..operators.graph import greedy_match
    pairs = jn_interval_overlap(spark, sf)
    return greedy_match(pairs, "id", "bid", "overlap_us")


@query("jn_tag_semi", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def jn_tag_semi(spark, sf):
    good = tb.load(spark, sf, "labels").where("quality = 1").select("doc_id")
    return tb.load(spark, sf, "documents").select("doc_id", "source").join(good, "doc_id", "left_semi")


@query("jn_orphan_anti", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def jn_orphan_anti(spark, sf):
    return tb.load(spark, sf, "documents").select("doc_id", "source").join(
        tb.load(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("jn_short_id_resolve", """WITH c AS (SELECT DISTINCT l_suppkey AS build, CAST(l_suppkey AS VARCHAR) || ':u' || l_linenumber AS id FROM lineitem),
 asked AS (SELECT DISTINCT 'u' || l_linenumber AS short FROM lineitem WHERE l_returnflag = 'R'),
 j AS (SELECT short, s_suppkey AS build FROM asked JOIN c ON c.id = CAST(c.build AS VARCHAR) || ':' || short JOIN supplier ON s_suppkey = c.build)
 SELECT short, build, build = max(build) OVER (PARTITION BY short) AS newest FROM j""")
def jn_short_id_resolve(spark, sf):
    li = tb.load(spark, sf, "lineitem")
    c = li.select(F.col("l_suppkey").alias("build"), F.concat(F.col("l_suppkey").cast("string"), F.lit(":u"), F.col("l_linenumber").cast("string")).alias("id")).distinct()
    asked = li.where("l_returnflag = 'R'").select(F.concat(F.lit("u"), F.col("l_linenumber").cast("string")).alias("short")).distinct()
    builds = tb.load(spark, sf, "supplier").select(F.col("s_suppkey").alias("build"))
    # The short id is what follows the build's own, so the id joins on both parts without a cross product.
    held = c.join(builds, "build").withColumn("short", F.expr("substring(id, length(cast(build as string)) + 2)")).join(asked, "short", "left_semi")
    newest = held.groupBy("short").agg(F.max("build").alias("__n"))
    return held.join(newest, "short").select("short", "build", (F.col("build") == F.col("__n")).alias("newest"))


@query("jn_words_under_effects", f"""WITH {q.AB} SELECT b.key, bid, string_agg(kind, ' ' ORDER BY s, id) AS words FROM b JOIN a ON a.key = b.key AND s < be AND bs < e GROUP BY b.key, bid""")
def jn_words_under_effects(spark, sf):
    pairs = iv.overlap_join(tb.spans_b(spark, sf), tb.spans_a(spark, sf), ["key"], ("bs", "be"), ("s", "e"), tb.BIN)
    words = F.array_sort(F.collect_list(F.struct("s", "id", "kind")))
    return pairs.groupBy("key", "bid").agg(F.array_join(F.transform(words, lambda w: w["kind"]), " ").alias("words"))


@query("jn_offer_diff", f"""WITH {q.VERSIONS}, j AS (SELECT vb.id, vb.cust <> va.cust AS c, vb.price <> va.price AS p, vb.status <> va.status AS st, va.id IS NULL AS gone FROM vb LEFT JOIN va ON vb.id = va.id)
 SELECT id, CASE WHEN gone THEN 'gone' ELSE array_to_string(list_filter([CASE WHEN c THEN 'cust' END, CASE WHEN p THEN 'price' END, CASE WHEN st THEN 'status' END], lambda x: x IS NOT NULL), ',') END AS changed
 FROM j WHERE gone OR c OR p OR st""")
def jn_offer_diff(spark, sf):
    before, after = tb.order_versions(spark, sf)

    def parts(name):
        return F.create_map(F.lit("cust"), F.col("cust").cast("string"), F.lit("price"), F.col("price").cast("string"),
                            F.lit("status"), F.col("status")).alias(name)
    j = before.select("id", parts("offered")).join(after.select("id", parts("now")), "id", "left")
    changed = F.map_keys(F.map_filter(F.map_zip_with("offered", "now", lambda k, a, b: ~a.eqNullSafe(b)), lambda k, v: v))
    return j.select("id", F.when(F.col("now").isNull(), "gone").otherwise(
        F.array_join(F.array_sort(changed), ",")).alias("changed")).where(F.col("changed") != "")


@query("jn_topmost", f"""WITH {q.AB}, {q.P_ONLY}, l AS (SELECT p.pid, CAST(ceil(bvalue) AS BIGINT) AS layer, bid AS clip FROM p JOIN b ON p.key = b.key AND bs <= t AND t < be
 UNION ALL SELECT p.pid, 0, id FROM p JOIN a ON p.key = a.key AND s <= t AND t < e)
 SELECT p.key, p.pid, arg_max(clip, (layer, clip)) AS clip FROM p LEFT JOIN l ON p.pid = l.pid GROUP BY p.key, p.pid""")
def jn_topmost(spark, sf):
    p = tb.moments(spark, sf)
    layers = tb.spans_b(spark, sf).select("key", "bs", "be", F.ceil("bvalue").cast("long").alias("layer"), F.col("bid").alias("clip")).unionByName(
        tb.spans_a(spark, sf).select("key", F.col("s").alias("bs"), F.col("e").alias("be"), F.lit(0).cast("long").alias("layer"), F.col("id").alias("clip")))
    hit = iv.point_join(p, layers, ["key"], "t", ("bs", "be"), tb.BIN).groupBy("pid").agg(F.max_by("clip", F.struct("layer", "clip")).alias("clip"))
    return p.join(hit, "pid", "left").select("key", "pid", "clip")


@query("jn_space_time", f"""WITH {q.AB}, k AS (SELECT id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM ev),
 x AS (SELECT a.*, k FROM a JOIN k ON a.id = k.id), y AS (SELECT b.*, k AS bk FROM b JOIN k ON b.bid = k.id)
 SELECT x.key, id, bid FROM x JOIN y ON x.key = y.key AND s < be AND bs < e
 WHERE greatest(0, least(value + 20, bvalue + 60) - greatest(value, bvalue)) * greatest(0, least(k + 20, bk + 60) - greatest(k, bk)) >= 0.5 * 400""")
def jn_space_time(spark, sf):
    k = tb.events(spark, sf).select("id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    a = tb.spans_a(spark, sf).join(k, "id")
    b = tb.spans_b(spark, sf).join(k.select(F.col("id").alias("bid"), F.col("k").alias("bk")), "bid")
    pairs = iv.overlap_join(a, b, ["key"], ("s", "e"), ("bs", "be"), tb.BIN)

    def along(x, size, y, other):
        return F.greatest(F.lit(0), F.least(F.col(x) + size, F.col(y) + other) - F.greatest(x, y))
    return pairs.where(along("value", 20, "bvalue", 60) * along("k", 20, "bk", 60) >= 0.5 * 400).select("key", "id", "bid")


@query("jn_overlap_replace", f"""WITH {q.AB} SELECT key, id, s, e, 'kept' AS part FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.key = b.key AND s < be AND bs < e)
 UNION ALL SELECT key, bid, bs, be, 'new' FROM b""")
def jn_overlap_replace(spark, sf):
    a = tb.spans_a(spark, sf).select("key", "id", "s", "e")
    b = tb.spans_b(spark, sf)
    hit = iv.overlap_join(a, b, ["key"], ("s", "e"), ("bs", "be"), tb.BIN).select("id")
    return a.join(hit, "id", "left_anti").select("key", "id", "s", "e", F.lit("kept").alias("part")).unionByName(
        b.select("key", F.col("bid").alias("id"), F.col("bs").alias("s"), F.col("be").alias("e"), F.lit("new").alias("part")))


@query("jn_mostly_over", f"""WITH {q.AB} SELECT key, id FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.key = b.key AND least(e, be) > greatest(s, bs) AND 2 * (least(e, be) - greatest(s, bs)) > e - s)""")
def jn_mostly_over(spark, sf):
    a = tb.spans_a(spark, sf).select("key", "id", "s", "e")
    pairs = iv.overlap_join(a, tb.spans_b(spark, sf), ["key"], ("s", "e"), ("bs", "be"), tb.BIN)
    hit = pairs.where(2 * iv.overlap_length("s", "e", "bs", "be") > F.col("e") - F.col("s")).select("id")
    return a.join(hit, "id", "left_semi").select("key", "id")


@query("jn_rulings_current", f"""WITH {q.VERSIONS}, r AS (SELECT id, price AS seq, CASE WHEN status = 'O' THEN 'keep' ELSE 'change' END AS verdict, CASE WHEN priority = '5-LOW' THEN ' ' ELSE priority END AS reason FROM va)
 SELECT vb.id, CASE WHEN r.id IS NULL THEN 'not ruled' WHEN r.seq <> vb.price THEN 'ruled on another sequence' WHEN verdict = 'keep' AND trim(reason) <> '' THEN 'settled' ELSE 'ruled, still there' END AS standing
 FROM vb LEFT JOIN r ON vb.id = r.id""")
def jn_rulings_current(spark, sf):
    before, after = tb.order_versions(spark, sf)
    r = after.select("id", F.col("price").alias("seq"), F.when(F.col("status") == "O", "keep").otherwise("change").alias("verdict"),
                     F.when(F.col("priority") == "5-LOW", " ").otherwise(F.col("priority")).alias("reason"))
    j = before.join(r, "id", "left")
    settled = (F.col("verdict") == "keep") & (F.trim("reason") != "")
    return j.select("id", F.when(F.col("verdict").isNull(), "not ruled").when(F.col("seq") != F.col("price"), "ruled on another sequence")
                    .when(settled, "settled").otherwise("ruled, still there").alias("standing"))
