"""Queries of the filters, predicates and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as pr
from ..operators import intervals as iv
from ..operators import transcript as tr
from ..operators.ordered import spread_join
from ..sources import tables as tb
from . import sqlbase as q
from .registry import query

_IDS = f"WITH {q.CLIPS} SELECT id, key, level, kind, s, e FROM clips"


def _ids(df):
    return df.select("id", "key", "level", "kind", "s", "e")


@query("flt_clip_query", f"""{_IDS} WHERE level = 'section' AND kind IN ('speech', 'ambient') AND lower(text) LIKE '%the%' AND e > 100
 AND s < 900 AND e - s >= 60 AND length >= 1500 AND (lang = 'en' OR quality = 1) AND quality <= 1 ORDER BY key, s, id LIMIT 50""")
def flt_clip_query(spark, sf):
    c = tb.clips(spark, sf)
    found = c.where(pr.has_tag("en") | pr.has_tag("good"))
    return _ids(pr.query_clips(found, level="section", kinds=("speech", "ambient"), text="the", start=100, end=900, shortest=60,
                               low={"length": 1500}, high={"quality": 1}))


@query("flt_level_kind_in", f"{_IDS} WHERE level = 'utterance' AND kind IN ('speech', 'silence') AND key IN ('src0', 'src3', 'src5')")
def flt_level_kind_in(spark, sf):
    return _ids(pr.query_clips(tb.clips(spark, sf), level="utterance", kinds=("speech", "silence"),
                               keys=("src0", "src3", "src5"), limit=None))


@query("flt_tag_exists", f"{_IDS} WHERE quality = 1")
def flt_tag_exists(spark, sf):
    return _ids(pr.query_clips(tb.clips(spark, sf), tag="good", limit=None))


@query("flt_text_literal", f"""{_IDS} WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '%')
 OR contains(translate(coalesce(description, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '%')""")
def flt_text_literal(spark, sf):
    return _ids(pr.query_clips(tb.clips(spark, sf), text="%", limit=None))


@query("flt_time_window", f"{_IDS} WHERE e > 250 AND s < 700")
def flt_time_window(spark, sf):
    return _ids(pr.query_clips(tb.clips(spark, sf), start=250, end=700, limit=None))


@query("flt_duration", f"{_IDS} WHERE e - s >= 20 AND e - s <= 200")
def flt_duration(spark, sf):
    return _ids(pr.query_clips(tb.clips(spark, sf), shortest=20, longest=200, limit=None))


@query("flt_score_bounds", f"{_IDS} WHERE length >= 500 AND quality >= 1 AND toxic <= 0")
def flt_score_bounds(spark, sf):
    return _ids(pr.query_clips(tb.clips(spark, sf), low={"length": 500, "quality": 1}, high={"toxic": 0}, limit=None))


_BARE = "regexp_replace({}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


@query("flt_made_up_lines", f"""WITH {q.WORDS}, w AS (SELECT *, {_BARE.format('text')} AS said FROM words),
 f AS (SELECT *, CASE WHEN said <> '' AND said = lag(said) OVER (PARTITION BY key, turn ORDER BY ord) THEN 0 ELSE 1 END AS new FROM w),
 g AS (SELECT *, sum(new) OVER (PARTITION BY key, turn ORDER BY ord) AS grp FROM f),
 r AS (SELECT key, turn, max(n) AS run FROM (SELECT key, turn, grp, count(*) AS n FROM g GROUP BY 1, 2, 3) GROUP BY 1, 2),
 u AS (SELECT key, turn, count(*) AS n, sum(CASE WHEN e <= s THEN 1 ELSE 0 END) AS empty, arg_min(prob, ord) AS first, avg(prob) AS mean FROM w GROUP BY 1, 2)
 SELECT c.conv_id AS key, c.turn, coalesce(regexp_matches({_BARE.format('c.text')}, '^中文字幕|字幕[組组由提供志]|不吝[點点][贊赞讚]|[點点]{{2}}[欄栏]目|^([謝谢][謝谢]|感[謝谢]|多[謝谢])(觀看|观看|收看|收聽|收听)$')
  OR empty / n >= 0.5 OR run >= 6 OR (first < 0.02 AND empty > 0) OR mean < 0.15, false) AS made_up
 FROM conversations c LEFT JOIN u ON c.conv_id = u.key AND c.turn = u.turn LEFT JOIN r ON c.conv_id = r.key AND c.turn = r.turn"""
       .replace("mean < 0.15", "mean < 0.1"))
def flt_made_up_lines(spark, sf):
    seg = tb.load(spark, sf, "conversations").select(F.col("conv_id").alias("key"), "turn", "text")
    return tr.made_up(seg, tb.words(spark, sf), ["key", "turn"], "ord", 1_000_000).select("key", "turn", "made_up")


_SHARES = """sh AS (SELECT a.key, a.id, a.kind, a.value, CASE WHEN e <= s THEN 0 ELSE least(1, coalesce(c, 0)::DOUBLE / (e - s)) END AS share FROM a LEFT JOIN
 (SELECT id, sum(least(e, be) - greatest(s, bs)) AS c FROM a JOIN b ON a.key = b.key AND s < be AND bs < e GROUP BY id) o ON a.id = o.id),
 au AS (SELECT key, max(value) >= 150 AS has_audio FROM ev GROUP BY key)"""


def _shares(spark, sf):
    a = tb.spans_a(spark, sf)
    c = iv.covered(a, tb.spans_b(spark, sf), ["key"], ["id"], ("s", "e"), ("bs", "be"), tb.BIN)
    heard = tb.events(spark, sf).groupBy("key").agg((F.max("value") >= 150).alias("has_audio"))
    return spread_join(c.withColumn("share", iv.share("covered", "s", "e")), heard, "key")


@query("flt_audible", f"WITH {q.AB}, {_SHARES} SELECT sh.key, id FROM sh JOIN au ON sh.key = au.key WHERE NOT has_audio OR share < 0.9")
def flt_audible(spark, sf):
    return _shares(spark, sf).where(pr.audible(F.col("share"), F.col("has_audio"))).select("key", "id")


@query("prj_kind", f"""WITH {q.AB}, {_SHARES} SELECT sh.key, id, CASE WHEN sh.kind IN ('click', 'view') AND (NOT has_audio OR share < 0.9) THEN 'speech'
 WHEN value / 100 >= 0.5 OR value / 200 >= 0.5 THEN 'unusable' WHEN has_audio AND share >= 0.9 THEN 'silence' ELSE 'ambient' END AS kind
 FROM sh JOIN au ON sh.key = au.key""")
def prj_kind(spark, sf):
    return _shares(spark, sf).select("key", "id", pr.clip_kind(
        F.col("kind").isin("click", "view"), F.col("has_audio"), F.col("share"), F.col("value") / 100,
        F.col("value") / 200).alias("kind"))


@query("flt_stale", """WITH r AS (SELECT o_orderkey AS id, o_orderstatus AS version, CASE WHEN o_totalprice >= 150000 THEN o_orderpriority END AS model, o_orderdate FROM orders),
 c AS (SELECT version AS cv, model AS cm FROM r ORDER BY o_orderdate DESC, id DESC LIMIT 1)
 SELECT id FROM r, c WHERE version IS DISTINCT FROM cv OR (model IS NOT NULL AND model IS DISTINCT FROM cm)""")
def flt_stale(spark, sf):
    r = tb.load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("version"),
        F.when(F.col("o_totalprice") >= 150000, F.col("o_orderpriority")).alias("model"), "o_orderdate")
    now = r.agg(F.max_by(F.struct(F.col("version").alias("cv"), F.col("model").alias("cm")),
                         F.struct("o_orderdate", "id")).alias("now"))
    # The current recipe is one row by construction.
    return r.join(F.broadcast(now.select("now.*"))).where(
        pr.stale({"model": ("model", "cm")}, {"version": ("version", "cv")})).select("id")


@query("flt_clipping", f"""WITH {q.SERIES},
 a AS (SELECT key AS user, id, kind AS key, t AS s, e FROM (SELECT *, lead(t) OVER (PARTITION BY key ORDER BY t, id) AS e FROM ev) WHERE e IS NOT NULL),
 hot AS (SELECT key, {q.EPOCH} + sec * {q.HOUR} AS hs FROM series WHERE peak >= 150 AND n >= 3)
 SELECT a.key, id, count(*) AS seconds, min(greatest(hs, s) - s) AS first_us FROM a JOIN hot ON a.key = hot.key AND s < hs + {q.HOUR} AND hs < e GROUP BY a.key, id""")
def flt_clipping(spark, sf):
    hot = tb.series(spark, sf).where((F.col("peak") >= 150) & (F.col("n") >= 3)).select(
        "key", (F.col("sec") * tb.HOUR + tb.EPOCH).alias("hs")).withColumn("he", F.col("hs") + tb.HOUR)
    a = tb.spans_a(spark, sf).select(F.col("kind").alias("key"), "id", "s", "e")
    pairs = iv.overlap_join(a, hot, ["key"], ("s", "e"), ("hs", "he"), tb.BIN)
    return pairs.groupBy("key", "id").agg(F.count(F.lit(1)).alias("seconds"),
                                          F.min(F.greatest("hs", "s") - F.col("s")).alias("first_us"))


@query("flt_waiting_items", """WITH c AS (SELECT conv_id AS key, arg_min(role, turn) = 'system' AS question, count(*) >= 4 AS open,
 bool_or(role = 'user' AND turn > 0) AS answered FROM conversations GROUP BY conv_id) SELECT key, question FROM c WHERE open AND (NOT question OR answered)""")
def flt_waiting_items(spark, sf):
    c = tb.load(spark, sf, "conversations").groupBy(F.col("conv_id").alias("key")).agg(
        (F.min_by("role", "turn") == "system").alias("question"), (F.count(F.lit(1)) >= 4).alias("open"),
        F.bool_or((F.col("role") == "user") & (F.col("turn") > 0)).alias("answered"))
    return c.where(F.col("open") & (~F.col("question") | F.col("answered"))).select("key", "question")


@query("flt_library_class", """WITH l AS (SELECT l_partkey, round(avg(l_discount) * 10, 4) AS share FROM lineitem GROUP BY 1)
 SELECT p_partkey AS id, CASE WHEN p_type = 'ECONOMY' OR p_type = 'PROMO' THEN 'footage' WHEN p_size < 10 THEN 'sfx' WHEN share >= 0.5 THEN 'footage' ELSE 'music' END AS library
 FROM part LEFT JOIN l ON p_partkey = l_partkey""")
def flt_library_class(spark, sf):
    share = tb.load(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.round(F.avg("l_discount") * 10, 4).alias("share"))
    return tb.load(spark, sf, "part").join(share, "p_partkey", "left").select(
        F.col("p_partkey").alias("id"), pr.library_class(
            F.col("p_type") == "ECONOMY", F.col("p_type") != "PROMO", F.col("p_size"), F.col("share")).alias("library"))


_LIC = ", ".join(f"'{x}'" for x in (*pr.LICENCES, "Other"))


@query("flt_licence_rules", f"""WITH t AS (SELECT c_custkey AS id, ([{_LIC}])[c_nationkey % 9 + 1] AS licence, c_mktsegment <> 'HOUSEHOLD' AS per_track,
 c_mktsegment = 'MACHINERY' AS personal FROM customer), u AS (SELECT *, licence LIKE '%-NC%' AS nc, licence LIKE '%-ND%' AS nd FROM t)
 SELECT id, CASE WHEN licence = 'Other' THEN 'say the licence' ELSE 'does not allow ' || CASE WHEN nc AND nd THEN 'commercial use or changes' WHEN nc THEN 'commercial use' ELSE 'changes' END END AS problem
 FROM u WHERE per_track AND (licence = 'Other' OR ((nc OR nd) AND NOT personal))""")
def flt_licence_rules(spark, sf):
    names = F.array(*[F.lit(x) for x in (*pr.LICENCES, "Other")])
    t = tb.load(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.element_at(names, F.col("c_nationkey") % 9 + 1).alias("licence"),
        (F.col("c_mktsegment") != "HOUSEHOLD").alias("per_track"), (F.col("c_mktsegment") == "MACHINERY").alias("personal"))
    return t.select("id", pr.licence_problem(F.col("per_track"), F.col("licence"), F.col("personal")).alias("problem")).where(
        F.col("problem").isNotNull())


@query("flt_recent_jobs", """SELECT o_orderkey AS job, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'active' ELSE 'ended' END AS part, o_orderdate AS created
 FROM orders WHERE o_orderstatus IN ('O', 'P') OR o_orderdate >= TIMESTAMP '1998-01-01'""")
def flt_recent_jobs(spark, sf):
    o = tb.load(spark, sf, "orders")
    active = F.col("o_orderstatus").isin("O", "P")
    return o.where(active | (F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))).select(
        F.col("o_orderkey").alias("job"), F.when(active, "active").otherwise("ended").alias("part"),
        F.col("o_orderdate").alias("created")).orderBy("part", "created", "job")


@query("flt_ttl", "SELECT o_orderkey AS id FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' - INTERVAL 365 DAYS")
def flt_ttl(spark, sf):
    return tb.load(spark, sf, "orders").where(
        F.col("o_orderdate") < F.expr("timestamp_ntz'1999-01-01' - INTERVAL 365 DAYS")).select(F.col("o_orderkey").alias("id"))


@query("prj_clip_summary", f"""WITH {q.CLIPS} SELECT id, key, kind, e - s AS duration, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '…' ELSE text END AS text,
 description, list_filter([lang, CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS tags, length AS score_length FROM clips""")
def prj_clip_summary(spark, sf):
    c = tb.clips(spark, sf)
    kept = F.map_filter("scores", lambda k, v: k.isin("length", "words_per_second"))
    return c.select("id", "key", "kind", (F.col("e") - F.col("s")).alias("duration"), pr.summary_text(F.col("text")).alias("text"),
                    "description", F.transform("tags", lambda t: t["value"]).alias("tags"), kept["length"].alias("score_length"))
