"""Queries of the rankings and sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import topk
from ..session import cut_lineage
from ..sources import tables as tb
from . import sqlbase as q
from .registry import query

_X = "x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings)"


@query("top_meaning_search", f"""WITH {_X}, qv AS (SELECT d, avg(v) AS q FROM x WHERE label = 3 GROUP BY d), sc AS (SELECT vec_id AS id, round(sum(v * q) / sqrt(sum(v * v) * sum(q * q)), 9) AS score FROM x JOIN qv ON x.d = qv.d GROUP BY vec_id)
 SELECT id, round(score, 6) AS score, round(max(score) OVER (), 6) AS highest, round(min(score) OVER (), 6) AS lowest, round(quantile_cont(score, 0.5) OVER (), 6) AS median FROM sc ORDER BY sc.score DESC, id LIMIT 20 OFFSET 5""")
def top_meaning_search(spark, sf):
    e = tb.load(spark, sf, "embeddings")
    query_ = topk.mean_vectors(e.where("label = 3"), [], "embedding")
    r = topk.meaning_search(e.withColumnRenamed("vec_id", "id"), query_, "id", "embedding", 20, 5)
    return r.select("id", *[F.round(c, 6).alias(c) for c in ("score", "highest", "lowest", "median")])


@query("top_vector_knn", f"""WITH {_X}, qv AS (SELECT label AS query, d, avg(v) AS q FROM x GROUP BY label, d), sc AS (SELECT query, vec_id AS id, round(sum(v * q) / sqrt(sum(v * v) * sum(q * q)), 9) AS score FROM x JOIN qv ON x.d = qv.d
 WHERE vec_id IN (SELECT vec_id FROM embeddings WHERE embedding[1] >= 0) GROUP BY query, vec_id)
 SELECT query, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY sc.score DESC, id) AS place FROM sc QUALIFY place <= 5""")
def top_vector_knn(spark, sf):
    e = tb.load(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")
    queries = topk.mean_vectors(e.withColumn("label", F.col("label")), ["label"], "embedding").select(F.col("label").alias("q"), "query")
    r = topk.knn(e.where(F.col("embedding")[0] >= 0), queries, "id", "embedding", "q", 5)
    return r.select(F.col("q").alias("query"), "id", F.round("score", 6).alias("score"), "place")


_CAND = """cd AS (SELECT l_suppkey AS stretch, l_partkey AS clip, any_value(p_brand) AS file, bool_or(l_returnflag = 'R') AS shares, max(l_discount) AS score, bool_and(l_linestatus = 'F') AS unread
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def _cands(spark, sf):
    li = tb.load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("stretch"), F.col("l_partkey").alias("clip")).agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("shares"), F.max("l_discount").alias("score"), F.bool_and(F.col("l_linestatus") == "F").alias("unread"))
    return li.join(tb.load(spark, sf, "part").select(F.col("p_partkey").alias("clip"), F.col("p_brand").alias("file")), "clip")


_ORD = "CASE WHEN shares THEN 0 ELSE 1 END, score DESC, clip"
_QUOTA = f"""bf AS (SELECT *, row_number() OVER (PARTITION BY stretch, unread, file ORDER BY {_ORD}) AS f FROM cd QUALIFY f <= 2), un AS (SELECT stretch, count(*) AS u FROM cd WHERE unread GROUP BY 1),
 r1 AS (SELECT bf.stretch, clip, file FROM bf LEFT JOIN un ON bf.stretch = un.stretch WHERE NOT unread QUALIFY row_number() OVER (PARTITION BY bf.stretch ORDER BY {_ORD}) <= 8 - least(2, coalesce(u, 0))),
 u2 AS (SELECT bf.*, coalesce(c, 0) AS c, coalesce(t, 0) AS t FROM bf LEFT JOIN (SELECT stretch, file, count(*) AS c FROM r1 GROUP BY 1, 2) x ON x.stretch = bf.stretch AND x.file = bf.file LEFT JOIN (SELECT stretch, count(*) AS t FROM r1 GROUP BY 1) y ON y.stretch = bf.stretch WHERE unread),
 r2 AS (SELECT stretch, clip, file FROM (SELECT * FROM u2 WHERE f + c <= 2) QUALIFY row_number() OVER (PARTITION BY stretch ORDER BY {_ORD}) <= 8 - t), r12 AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2),
 u3 AS (SELECT bf.* EXCLUDE f, row_number() OVER (PARTITION BY bf.stretch, bf.file ORDER BY {_ORD}) AS f, coalesce(c, 0) AS c, coalesce(t, 0) AS t FROM bf LEFT JOIN (SELECT stretch, file, count(*) AS c FROM r12 GROUP BY 1, 2) x ON x.stretch = bf.stretch AND x.file = bf.file
  LEFT JOIN (SELECT stretch, count(*) AS t FROM r12 GROUP BY 1) y ON y.stretch = bf.stretch WHERE NOT unread AND NOT EXISTS (SELECT 1 FROM r12 WHERE r12.stretch = bf.stretch AND r12.clip = bf.clip)),
 r3 AS (SELECT stretch, clip, file FROM (SELECT * FROM u3 WHERE f + c <= 2) QUALIFY row_number() OVER (PARTITION BY stretch ORDER BY {_ORD}) <= 8 - t), al AS (SELECT * FROM r12 UNION ALL SELECT * FROM r3),
 fin AS (SELECT cd.stretch, cd.clip, cd.file, cd.unread, row_number() OVER (PARTITION BY cd.stretch ORDER BY unread, {_ORD.replace(' clip', ' cd.clip')}) AS place FROM cd JOIN al ON al.stretch = cd.stretch AND al.clip = cd.clip)"""


def _quota(spark, sf):
    return topk.with_quotas(_cands(spark, sf), "stretch", "clip", "file", "unread",
                            [F.when(F.col("shares"), 0).otherwise(1), F.col("score").desc(), F.col("clip")])


@query("top_with_quotas", f"WITH {_CAND}, {_QUOTA} SELECT * FROM fin")
def top_with_quotas(spark, sf):
    return _quota(spark, sf)


@query("top_variety", f"""WITH {_CAND}, {_QUOTA}, tp AS (SELECT * FROM fin WHERE place <= 3)
 SELECT fin.stretch, fin.clip, count(*) AS others, min(tp.stretch) AS first_other FROM fin JOIN tp ON tp.clip = fin.clip AND tp.stretch <> fin.stretch GROUP BY 1, 2""")
def top_variety(spark, sf):
    return topk.variety(cut_lineage(_quota(spark, sf)), "stretch", "clip", "place")


_COVER = f"""bad AS (SELECT key, t - {q.HOUR} AS x, t + {q.HOUR} AS y FROM ev WHERE kind = 'error'),
 cn AS (SELECT b.bid, ev.t AS m, CASE WHEN kind IN ('click', 'view') THEN 0 ELSE 1 END AS tier, CASE WHEN kind IN ('click', 'view') THEN -value ELSE value END AS o FROM b JOIN ev ON ev.key = b.key AND bs <= ev.t AND ev.t < be WHERE kind IN ('click', 'view', 'signup')
  AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.key = b.key AND x <= ev.t AND ev.t < y) UNION ALL
  SELECT bid, (bs + be) // 2, 2, 0 FROM b WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.key = b.key AND x <= (bs + be) // 2 AND (bs + be) // 2 < y)),
 cv AS (SELECT bid, arg_min(m, (tier, o, m)) AS moment, min(tier) AS tier FROM cn GROUP BY bid)"""


def _cover(spark, sf):
    b, ev = tb.spans_b(spark, sf), tb.events(spark, sf)
    bad = ev.where("kind = 'error'").select("key", (F.col("t") - tb.HOUR).alias("x"), (F.col("t") + tb.HOUR).alias("y"))
    seen = F.col("kind").isin("click", "view")
    pts = ev.where(F.col("kind").isin("click", "view", "signup")).select("key", F.col("t").alias("m"), F.when(seen, 0).otherwise(1).alias("tier"), F.when(seen, -F.col("value")).otherwise(F.col("value")).alias("o"))
    inside = iv.point_join(pts, b, ["key"], "m", ("bs", "be"), tb.BIN).select("key", "bid", "m", "tier", "o")
    mid = b.select("key", "bid", F.expr("(bs + be) div 2").alias("m"), F.lit(2).alias("tier"), F.lit(0.0).alias("o"))
    cands = inside.unionByName(mid)
    shown = iv.point_join(cands.select("key", "bid", "m"), bad, ["key"], "m", ("x", "y"), tb.BIN).select("bid", "m")
    return b, bad, cands.join(shown, ["bid", "m"], "left_anti").groupBy("bid").agg(F.min(F.struct("tier", "o", "m")).alias("c")).select(
        "bid", F.col("c.m").alias("moment"), F.col("c.tier").alias("tier"))


@query("top_cover_moment", f"WITH {q.B}, {_COVER} SELECT bid, moment, tier FROM cv")
def top_cover_moment(spark, sf):
    return _cover(spark, sf)[2]


@query("top_spread_picks")
def top_spread_picks(spark, sf):
    b, bad, cover = _cover(spark, sf)
    grid = b.select("key", "bid", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("n"), "bs", "be").withColumn(
        "m", F.col("bs") + F.floor((F.col("be") - F.col("bs")) * (F.col("n") + 0.5) / 12).cast("long"))
    shown = iv.point_join(grid.select("key", "bid", "m"), bad, ["key"], "m", ("x", "y"), tb.BIN).select("bid", "m")
    # Twelve tries a span at most.
    tries = grid.join(shown, ["bid", "m"], "left_anti").groupBy("bid").agg(F.array_sort(F.collect_set("m")).alias("tries"))
    spans = b.select("bid").join(cover, "bid", "left").join(tries, "bid", "left")
    return topk.spread_picks(spans, "bid", "bs", "be", "moment", "tries", 3, 30 * 60 * tb.SECOND)


@query("top_lru_evict", """WITH r AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS bytes, o_orderdate, coalesce(sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM orders)
 SELECT id, bytes FROM r WHERE before < 1000000000""")
def top_lru_evict(spark, sf):
    u = tb.load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.floor("o_totalprice").cast("long").alias("bytes"), tb.micros("o_orderdate").alias("used"))
    return topk.evict(u, "used", "id", "bytes", 1_000_000_000, tb.HOUR).select("id", "bytes")


@query("top_newest_per_group", "SELECT doc_id AS id, max(doc_id) OVER (PARTITION BY source, lang) AS newest FROM documents QUALIFY id <> newest")
def top_newest_per_group(spark, sf):
    d = tb.load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "lang")
    top = d.groupBy("source", "lang").agg(F.max("id").alias("newest"))
    return d.join(top, ["source", "lang"]).where("id <> newest").select("id", "newest")


@query("srt_natural", r"""SELECT page_id AS id, array_to_string(list_transform(regexp_extract_all(lower(url), '\d+|\D+'), lambda p: CASE WHEN regexp_matches(p, '^\d') THEN lpad(greatest(length(ltrim(p, '0')), 1)::VARCHAR, 10, '0') || CASE WHEN ltrim(p, '0') = '' THEN '0' ELSE ltrim(p, '0') END ELSE p END), '') AS sort_key FROM pages""")
def srt_natural(spark, sf):
    return tb.load(spark, sf, "pages").select(F.col("page_id").alias("id"), topk.natural_key(F.col("url")).alias("sort_key")).orderBy("sort_key", "id")


@query("srt_shot_order", """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderdate END AS moment FROM orders ORDER BY moment NULLS LAST, o_orderpriority, o_orderkey LIMIT 500 OFFSET 200""")
def srt_shot_order(spark, sf):
    o = tb.load(spark, sf, "orders").withColumn("moment", F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate")))
    return o.orderBy(F.col("moment").asc_nulls_last(), "o_orderpriority", "o_orderkey").offset(200).limit(500).select(F.col("o_orderkey").alias("id"), "moment")
