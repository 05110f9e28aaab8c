"""SQL for the canonical shapes, shared by the SQL twins of the queries."""

SECOND = 1_000_000
HOUR = 3600 * SECOND
EPOCH = 1_704_067_200 * SECOND

EV = "ev AS (SELECT user_id AS key, event_id AS id, event_type AS kind, value, epoch_us(ts) AS t, props FROM events)"
A = EV + """, a AS (SELECT key, id, kind, value, t AS s, e FROM (
  SELECT *, lead(t) OVER (PARTITION BY key ORDER BY t, id) AS e FROM ev) WHERE e IS NOT NULL)"""
B_ONLY = """b AS (SELECT key, id AS bid, t AS bs, t + CAST(round(value * 600 * 1000000) AS BIGINT) AS be, value AS bvalue
  FROM ev WHERE kind = 'purchase')"""
B = EV + ", " + B_ONLY
AB = A + ", " + B_ONLY
P_ONLY = "p AS (SELECT key, id AS pid, t FROM ev WHERE kind = 'error')"
# The coalesced purchases of a user.
BC = """bm AS (SELECT *, max(be) OVER (PARTITION BY key ORDER BY bs, bid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
 bg AS (SELECT *, sum(CASE WHEN reach IS NULL OR bs > reach THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY bs, bid) AS grp FROM bm),
 bc AS (SELECT key, min(bs) AS cs, max(be) AS ce, count(*) AS n FROM bg GROUP BY key, grp)"""
SERIES = EV + f""", series AS (SELECT kind AS key, (t - {EPOCH}) // {HOUR} AS sec,
  round(-20 - avg(value) / 9.7, 7) AS loudness, max(value) AS peak, count(*) AS n FROM ev GROUP BY 1, 2)"""
PLACED = A + """, pl0 AS (SELECT *, CASE WHEN kind = 'click' THEN 2 ELSE 1 END AS speed FROM a),
 pl1 AS (SELECT *, (e - s) // speed AS len FROM pl0),
 pl AS (SELECT *, CAST(coalesce(sum(len) OVER (PARTITION BY key ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS tl,
   CAST(coalesce(sum(len) OVER (PARTITION BY key ORDER BY s, id), 0) AS BIGINT) AS tle,
   row_number() OVER (PARTITION BY key ORDER BY s, id) AS pos FROM pl1)"""
CLIPS = """clips AS (SELECT d.doc_id AS id, d.source AS key,
  CASE WHEN n_chars >= 2000 THEN 'section' ELSE 'utterance' END AS level,
  CASE lang WHEN 'en' THEN 'speech' WHEN 'fr' THEN 'ambient' WHEN 'de' THEN 'silence' ELSE 'action' END AS kind,
  CAST(d.doc_id AS DOUBLE) AS s, d.doc_id + n_chars / 15.0::DOUBLE AS e, d.text,
  CASE WHEN lang <> 'de' THEN d.source END AS description, lang, quality, toxic, CAST(n_chars AS DOUBLE) AS length
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
PER = SECOND // 15
SENT = f"""raw AS (SELECT doc_id AS key, unnest(string_split_regex(regexp_replace(text, '([.!?])', '\\1' || chr(1), 'g'), chr(1) || '|\n')) AS text,
   generate_subscripts(string_split_regex(regexp_replace(text, '([.!?])', '\\1' || chr(1), 'g'), chr(1) || '|\n'), 1) - 1 AS seg FROM documents),
 rl AS (SELECT *, length(text) AS len FROM raw),
 rc AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY key ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM rl),
 sent AS (SELECT key, seg, trim(text, ' ') AS text, CAST(c * {PER} AS BIGINT) AS s, CAST((c + len) * {PER} AS BIGINT) AS e
   FROM rc WHERE trim(text, ' ') <> '')"""
WORDS = f"""w0 AS (SELECT conv_id AS key, turn, role AS speaker, unnest(string_split_regex(text, '\\s+')) AS text,
   generate_subscripts(string_split_regex(text, '\\s+'), 1) - 1 AS idx FROM conversations),
 w1 AS (SELECT *, turn * 1000000 + idx AS ord, length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS letters FROM w0 WHERE text <> ''),
 w2 AS (SELECT *, letters + CASE WHEN regexp_matches(text, '[.!?]$') THEN 9 WHEN regexp_matches(text, '[,;:]$') THEN 4 ELSE 1 END AS step FROM w1),
 w3 AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY key ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM w2),
 words AS (SELECT key, turn, CAST(idx AS BIGINT) AS idx, ord, speaker, text, CAST(c * {PER} AS BIGINT) AS s, CAST((c + letters) * {PER} AS BIGINT) AS e,
   CASE WHEN letters > 0 THEN 1.0::DOUBLE / letters ELSE 0.01::DOUBLE END AS prob FROM w3)"""
TURNS = f"""t0 AS (SELECT conv_id AS key, turn, role AS speaker, text, length(text) AS len FROM conversations),
 t1 AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY key ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM t0),
 turns AS (SELECT key, turn, speaker, text, CAST(c * {PER} AS BIGINT) AS s, CAST((c + len) * {PER} AS BIGINT) AS e FROM t1)"""
VERSIONS = """o AS (SELECT o_orderkey AS id, o_custkey AS cust, o_orderstatus AS status, o_totalprice AS price, o_orderpriority AS priority FROM orders),
 vb AS (SELECT * FROM o WHERE status <> 'P'),
 va AS (SELECT id, CASE WHEN priority = '2-HIGH' THEN cust + 1 ELSE cust END AS cust, status,
   CASE WHEN priority = '1-URGENT' THEN price + 1.0 ELSE price END AS price, priority FROM o WHERE status <> 'F')"""
