"""Queries of the scalar and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions import text as tx
from ..operators import names as nm
from ..operators import slots as sl
from ..operators.ordered import by_width, nxt, ordered_scan, prev
from ..operators.sequence import vocabulary_overlap
from ..operators.topk import mean_vectors
from ..operators.transcript import bare
from ..sources import sinks
from ..sources import tables as tb
from . import sqlbase as q
from .q_joins import _look_sql, _looks
from .registry import query


@query("fn_bare_words", r"SELECT doc_id AS id, md5(lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g'))) AS bare FROM documents")
def fn_bare_words(spark, sf):
    return tb.load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.md5(F.lower(bare(F.col("text")))).alias("bare"))


_TOK = "tk AS (SELECT conv_id AS key, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM conversations), tn AS (SELECT key, turn, token, count(*) AS n FROM tk GROUP BY 1, 2, 3)"


def _tokens(spark, sf):
    return tb.load(spark, sf, "conversations").select(F.col("conv_id").alias("key"), "turn", F.explode(sc.tokens(F.col("text"))).alias("token"))


@query("fn_tokens", f"WITH {_TOK} SELECT * FROM tn")
def fn_tokens(spark, sf):
    return _tokens(spark, sf).groupBy("key", "turn", "token").agg(F.count(F.lit(1)).alias("n"))


@query("fn_bag_cosine", f"""WITH {_TOK}, s AS (SELECT key, turn, sum(n * n) AS ss FROM tn GROUP BY 1, 2), d AS (SELECT a.key, b.turn, sum(a.n * b.n) AS ab FROM tn a JOIN tn b ON a.key = b.key AND b.turn = a.turn + 1 AND a.token = b.token GROUP BY 1, 2)
 SELECT b.key, b.turn, round(coalesce(ab, 0) / sqrt(a.ss::DOUBLE * b.ss), 9) AS cosine FROM s a JOIN s b ON a.key = b.key AND b.turn = a.turn + 1 LEFT JOIN d ON d.key = b.key AND d.turn = b.turn""")
def fn_bag_cosine(spark, sf):
    # A window of one line each side is the cosine of neighbouring bags.
    return vocabulary_overlap(_tokens(spark, sf), ["key"], "turn", 1).select("key", "turn", F.round("overlap", 9).alias("cosine"))


@query("fn_vector_cosine_distance", """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings), c AS (SELECT label, d, avg(v) AS m FROM x GROUP BY 1, 2)
 SELECT vec_id AS id, round(1 - sum(v * m) / sqrt(sum(v * v) * sum(m * m)), 9) AS distance FROM x JOIN c ON x.label = c.label AND x.d = c.d GROUP BY vec_id""")
def fn_vector_cosine_distance(spark, sf):
    e = tb.load(spark, sf, "embeddings")
    return e.join(mean_vectors(e, ["label"], "embedding"), "label").select(
        F.col("vec_id").alias("id"), F.round(sc.cosine_distance(F.col("embedding"), F.col("query")), 9).alias("distance"))


@query("fn_hamming64", _look_sql().split(", c AS")[0] + " SELECT id, CAST(bit_count(xor(h0, h1)) AS INTEGER) AS bits FROM l")
def fn_hamming64(spark, sf):
    return _looks(spark, sf).select("id", sc.hamming64(F.col("h0"), F.col("h1")).alias("bits"))


def _neighbours(spark, sf):
    c = tb.load(spark, sf, "conversations").select(F.col("conv_id").alias("key"), "turn", "text")
    return ordered_scan(c, ["key"], ["turn"], by_width("turn", 10_000), {"before": prev(F.col("text"))}).where("before is not null")


@query("fn_similarity_ratio")
def fn_similarity_ratio(spark, sf):
    return _neighbours(spark, sf).select("key", "turn", F.round(tx.similarity_ratio(F.col("before"), F.col("text")), 6).alias("ratio"))


@query("fn_shared_runs", f"""WITH n AS (SELECT conv_id AS key, turn, lower(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS said, lower(text) AS text FROM conversations),
 w AS (SELECT key, turn, said, unnest(words) AS word, generate_subscripts(words, 1) AS wi FROM (SELECT *, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS words FROM n WHERE said IS NOT NULL)),
 c AS (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w),
 e AS (SELECT key, turn, word, wi, i, i + max(l) FILTER (contains(said, substr(word, i::INT, l::INT))) AS stop FROM (SELECT *, unnest(range(0, length(word) - i + 2)) AS l FROM c) GROUP BY key, turn, word, wi, i),
 m AS (SELECT *, lag(stop) OVER (PARTITION BY key, turn, wi ORDER BY i) AS before FROM e),
 r AS (SELECT key, turn, substr(word, i::INT, (stop - i)::INT) AS run, min((wi, i)) AS first FROM m WHERE stop > i AND (before IS NULL OR stop > before) GROUP BY 1, 2, 3),
 k AS (SELECT * FROM r WHERE length(run) >= CASE WHEN regexp_full_match(run, '[\\x00-\\x7F]*') THEN 3 ELSE 2 END AND NOT regexp_full_match(run, '\\p{{Nd}}+') AND run NOT IN ({", ".join(f"'{w}'" for w in tx.FILLERS)})),
 o AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM k x WHERE x.key = k.key AND x.turn = k.turn AND x.run <> k.run AND contains(x.run, k.run)))
 SELECT n.key, n.turn, coalesce(string_agg(run, '|' ORDER BY length(run) DESC, first), '') AS shared FROM n LEFT JOIN o ON o.key = n.key AND o.turn = n.turn WHERE said IS NOT NULL GROUP BY n.key, n.turn""")
def fn_shared_runs(spark, sf):
    return _neighbours(spark, sf).select("key", "turn", F.array_join(tx.shared_runs(F.col("before"), F.col("text")), "|").alias("shared"))


@query("fn_spoken_units", "SELECT doc_id AS id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS INTEGER) AS units FROM documents")
def fn_spoken_units(spark, sf):
    return tb.load(spark, sf, "documents").select(F.col("doc_id").alias("id"), sc.spoken_units(F.lower("text")).cast("int").alias("units"))


@query("fn_normalize", r"SELECT conv_id AS key, turn, md5(regexp_replace(lower(text), '^\s+|\s+$', '', 'g')) AS flat FROM conversations")
def fn_normalize(spark, sf):
    return tb.load(spark, sf, "conversations").select(F.col("conv_id").alias("key"), "turn", F.md5(tx.normalized(F.col("text"))).alias("flat"))


@query("fn_marker_match", r"""WITH c AS (SELECT conv_id AS key, turn, lower(text) AS t FROM conversations), n AS (SELECT *, coalesce(lag(t[-6:]) OVER w, '') AS b, coalesce(lead(t[1:6]) OVER w, '') AS a FROM c WINDOW w AS (PARTITION BY key ORDER BY turn)),
 j AS (SELECT *, CASE WHEN b = '' THEN t ELSE b || ' ' || t END AS l FROM n), k AS (SELECT key, turn, CASE WHEN a = '' THEN l ELSE l || ' ' || a END AS j, length(l) - length(t) AS f, length(l) AS p, unnest(['the', 'and', 'que', 'le']) AS m FROM j)
 SELECT key, turn, m AS marker FROM k WHERE regexp_matches(j[greatest(1, f + 1 - length(m) + 1 - 1):p + length(m)], '(^|[^a-z0-9])' || m || '([^a-z0-9]|$)') AND len(list_filter(range(1, CAST(length(j) AS BIGINT) + 1), lambda i: j[i:i + length(m) - 1] = m AND i - 1 < p AND i - 1 + length(m) > f AND (i = 1 OR NOT regexp_matches(j[i - 1:i - 1], '[a-z0-9]')) AND NOT regexp_matches(j[i + length(m):i + length(m)], '[a-z0-9]'))) > 0""")
def fn_marker_match(spark, sf):
    c = tb.load(spark, sf, "conversations").select(F.col("conv_id").alias("key"), "turn", F.lower("text").alias("t"))
    w = sl.with_neighbours(c, ["key"], "turn", "t")
    marks = F.array(*[F.when(F.col("__joined").rlike(sc.marker_pattern(m)), sl.reach(sc.marker_pattern(m))) for m in ("the", "and", "que", "le")])
    return w.select("key", "turn", F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("marker"))


@query("fn_mark_doubtful", f"""WITH {q.WORDS}, f AS (SELECT *, prob < 0.15 AS d FROM words), n AS (SELECT *, lag(d) OVER w AS pd, lead(d) OVER w AS nd FROM f WINDOW w AS (PARTITION BY key, turn ORDER BY ord))
 SELECT key, turn, string_agg(CASE WHEN d AND pd IS NOT TRUE THEN '⟦' ELSE '' END || text || CASE WHEN d AND nd IS NOT TRUE THEN '⟧' ELSE '' END, ' ' ORDER BY ord) AS marked FROM n GROUP BY key, turn""")
def fn_mark_doubtful(spark, sf):
    w = tb.words(spark, sf).withColumn("d", F.col("prob") < 0.15)
    n = ordered_scan(w, ["key", "turn"], ["ord"], by_width("ord", 1_000_000), {"pd": prev(F.col("d")), "nd": nxt(F.col("d"))})
    no = F.lit(False)
    piece = F.concat(F.when(F.col("d") & ~F.coalesce("pd", no), "⟦").otherwise(""), F.col("text"), F.when(F.col("d") & ~F.coalesce("nd", no), "⟧").otherwise(""))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", piece.alias("p")))), lambda x: x["p"]), " ")
    return n.groupBy("key", "turn").agg(line.alias("marked"))


_GLOSS = {"an": "on", "eau": "o", "le ": "la ", "the": "teh"}


@query("fn_glossary", "SELECT doc_id AS id, md5(" + "replace(" * len(_GLOSS) + "text" + "".join(f", '{a}', '{b}')" for a, b in _GLOSS.items()) + ") AS fixed FROM documents")
def fn_glossary(spark, sf):
    table = spark.createDataFrame(list(_GLOSS.items()), "heard string, meant string")
    listed = table.agg(F.array_sort(F.collect_list(F.struct("heard", "meant"))).alias("g"))
    # The glossary is one row.
    return tb.load(spark, sf, "documents").join(F.broadcast(listed)).select(
        F.col("doc_id").alias("id"), F.md5(sc.apply_glossary(F.col("text"), F.col("g"))).alias("fixed"))


def _blur(c):
    return f"regexp_replace(regexp_replace(regexp_replace({c}, '^([zcs])h', '\\1'), '^l', 'n'), '([ei])ng$', '\\1n')"


@query("fn_reading_blur", f"""WITH {q.WORDS}, u AS (SELECT key, ord, prob, lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS unit FROM words), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS pos FROM u WHERE unit <> ''),
 nw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS a FROM benchmark)
 SELECT key, pos AS start, a AS name, unit = a AS exact FROM r JOIN nw ON {_blur('unit')} = {_blur('a')} WHERE prob < 0.3 AND unit <> a""")
def fn_reading_blur(spark, sf):
    from ..operators.ordered import row_number
    w = tb.words(spark, sf).select("key", "ord", (F.col("prob") < 0.3).alias("unsure"), F.lower(bare(F.col("text"))).alias("unit")).where("unit <> ''")
    u = ordered_scan(w, ["key"], ["ord"], by_width("ord", 1_000_000), {"pos": row_number()})
    said = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    names = tb.load(spark, sf, "benchmark").select(said.alias("name")).distinct().select("name", F.lit(0).alias("k"), F.col("name").alias("unit"))
    # Here a word reads as it is written; for characters this is the table of their readings.
    readings = u.select("unit").unionByName(names.select("unit")).distinct().withColumn("reading", F.col("unit"))
    return nm.sound_alikes(u, ["key"], "pos", "unit", "unsure", names, readings)


@query("fn_missing_terms", r"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}') || regexp_extract_all(lower(text), '[a-z]+[ ,.]+[a-z]+')) AS term FROM benchmark) SELECT term FROM t WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE contains(lower(c.text), term))""")
def fn_missing_terms(spark, sf):
    said = [F.regexp_extract_all(F.lower("text"), F.lit(p), F.lit(0)) for p in ("[a-z]{5,}", "[a-z]+[ ,.]+[a-z]+")]
    terms = tb.load(spark, sf, "benchmark").select(F.explode(F.concat(*said)).alias("term")).distinct()
    return nm.missing_terms(tb.load(spark, sf, "conversations"), "text", terms, "term")


@query("fn_file_label", r"""WITH s AS (SELECT page_id AS id, regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS st FROM pages)
 SELECT id, CASE WHEN regexp_matches(st, '^(img|dji|dsc|dscf|mvi|gopr|gx|gh|vid|video|pxl|mov|movie|clip|mah|sam|rec|record|screen|screenshot|p|c)?[\W_]*\d[\d\W_]*[a-z]?$', 'i') THEN '' ELSE trim(regexp_replace(st, '^\d+[\s_\-.]+', '')) END AS label FROM s""")
def fn_file_label(spark, sf):
    return tb.load(spark, sf, "pages").select(F.col("page_id").alias("id"), sc.file_label(F.regexp_replace("url", "[?#].*$", "")).alias("label"))


@query("fn_clock", f"""WITH {q.EV}, s AS (SELECT id, CAST(floor(value * 60) AS BIGINT) AS s FROM ev) SELECT id, CASE WHEN s >= 3600 THEN format('{{}}:{{:02d}}:{{:02d}}', s // 3600, s // 60 % 60, s % 60) ELSE format('{{}}:{{:02d}}', s // 60, s % 60) END AS clock FROM s""")
def fn_clock(spark, sf):
    return tb.events(spark, sf).select("id", sc.clock(F.floor(F.col("value") * 60) * tb.SECOND).alias("clock"))


@query("fn_srt_time", f"WITH {q.EV}, s AS (SELECT id, (t % 86400000000 + 500) // 1000 AS m FROM ev) SELECT id, format('{{:02d}}:{{:02d}}:{{:02d}},{{:03d}}', m // 3600000, m // 60000 % 60, m // 1000 % 60, m % 1000) AS stamp FROM s")
def fn_srt_time(spark, sf):
    return tb.events(spark, sf).select("id", sinks.srt_time(F.col("t") % tb.DAY).alias("stamp"))


@query("fn_timecode", f"WITH {q.EV}, s AS (SELECT id, t % 86400000000 // 40000 AS f FROM ev) SELECT id, format('{{:02d}}:{{:02d}}:{{:02d}}:{{:02d}}', f // 90000, f // 1500 % 60, f // 25 % 60, f % 25) AS stamp FROM s")
def fn_timecode(spark, sf):
    return tb.events(spark, sf).select("id", sc.timecode(F.expr(f"(t % {tb.DAY}) div 40000"), 25).alias("stamp"))


@query("fn_db", "SELECT event_id AS id, round(greatest(-120, 20 * log10(value / 500)), 6) AS db, round(pow(10, greatest(-120, 20 * log10(value / 500)) / 20), 6) AS back FROM events")
def fn_db(spark, sf):
    db = sc.to_db(F.col("value") / 500)
    return tb.events(spark, sf).select("id", F.round(db, 6).alias("db"), F.round(sc.from_db(db), 6).alias("back"))


@query("fn_luminance_contrast", """WITH c AS (SELECT p_partkey AS id, substr(md5(CAST(p_partkey AS VARCHAR)), 1, 6) AS c FROM part), v AS (SELECT id, unnest([1, 3, 5]) AS at, ('0x' || c[at:at + 1])::BIGINT / 255.0::DOUBLE AS v FROM c),
 l AS (SELECT id, sum(CASE at WHEN 1 THEN 0.2126 WHEN 3 THEN 0.7152 ELSE 0.0722 END * CASE WHEN v <= 0.04045 THEN v / 12.92 ELSE pow((v + 0.055) / 1.055, 2.4) END) AS l FROM v GROUP BY id)
 SELECT id, round(l, 6) AS luminance, round(1.05 / (l + 0.05), 5) AS on_white FROM l""".replace("v AS (SELECT id, unnest([1, 3, 5]) AS at, ('0x'", "u AS (SELECT id, c, unnest([1, 3, 5]) AS n FROM c), v AS (SELECT id, n AS at, ('0x'").replace("c[at:at + 1])::BIGINT / 255.0::DOUBLE AS v FROM c)", "c[n:n + 1])::BIGINT / 255.0::DOUBLE AS v FROM u)").replace(" AS at,", " AS ch,").replace("CASE at WHEN", "CASE ch WHEN"))
def fn_luminance_contrast(spark, sf):
    lum = sc.luminance(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 6))
    return tb.load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.round(lum, 6).alias("luminance"), F.round(sc.contrast(F.lit(1.0), lum), 5).alias("on_white"))


@query("fn_remaining", """WITH j AS (SELECT o_orderkey AS job, o_totalprice / 500000 AS p, (epoch_us(TIMESTAMP '2003-01-01') - epoch_us(o_orderdate)) / 1e6 AS spent FROM orders WHERE o_orderstatus = 'P')
 SELECT job, CASE WHEN p >= 0.05 THEN CAST(round(spent * (1 - p) / p) AS BIGINT) END AS remaining FROM j""")
def fn_remaining(spark, sf):
    j = tb.load(spark, sf, "orders").where("o_orderstatus = 'P'")
    spent = (F.unix_micros(F.lit("2003-01-01").cast("timestamp")) - tb.micros("o_orderdate")) / 1e6
    return j.select(F.col("o_orderkey").alias("job"), sc.remaining(spent, F.col("o_totalprice") / 500000).alias("remaining"))


@query("fn_url_site", r"""WITH h AS (SELECT page_id AS id, lower(regexp_extract(url, '^https://([^/:?#]+)', 1)) AS h FROM pages)
 SELECT id, CASE WHEN h = 'example.com' OR h LIKE '%.example.com' THEN 'com' WHEN h = 'example.org' OR h LIKE '%.example.org' THEN 'org' END AS site FROM h""")
def fn_url_site(spark, sf):
    return tb.load(spark, sf, "pages").select(F.col("page_id").alias("id"), sc.site_of(F.col("url"), [("com", "example.com"), ("org", "example.org")]).alias("site"))


@query("fn_round_ms", "SELECT event_id AS id, CAST(CAST(value / 7 AS DECIMAL(20, 9)) AS DECIMAL(12, 3)) AS exact, floor(value / 7 * 1000) / 1000 AS floored FROM events")
def fn_round_ms(spark, sf):
    s = F.col("value") / 7
    return tb.events(spark, sf).select("id", sc.round_ms(s).alias("exact"), sc.floor_ms(s).alias("floored"))


@query("fn_text_on_words", "SELECT conv_id AS key, turn, text FROM conversations WHERE regexp_matches(text, '[\\p{L}\\p{N}]')")
def fn_text_on_words(spark, sf):
    w = tb.words(spark, sf)
    timed = F.transform(F.array_sort(F.collect_list(F.struct("ord", (F.col("s") / 1e6).alias("start"), (F.col("e") / 1e6).alias("end"), "text"))),
                        lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))
    lines = w.groupBy("key", "turn").agg(timed.alias("words"))
    c = tb.load(spark, sf, "conversations").select(F.col("conv_id").alias("key"), "turn", "text").join(lines, ["key", "turn"])
    put = c.select("key", "turn", tx.text_on_words(F.col("text"), F.col("words")).alias("w")).where("w is not null")
    # The pieces of a line together are the line as written.
    return put.select("key", "turn", F.array_join(F.transform("w", lambda x: x["text"]), "").alias("text"))
