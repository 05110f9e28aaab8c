"""The registered queries of these operators, thin over the operators, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.ann import nearest
from spanloom.llm.bpe import round_trip
from spanloom.llm.chat import format_chats, parsed, unescaped
from spanloom.llm.exact import exact_groups
from spanloom.llm.filters import filter_audit
from spanloom.llm.lines import without_repeated_lines
from spanloom.llm.mixing import mix
from spanloom.llm.near import near_duplicates
from spanloom.llm.quality import held_out, learn, score
from spanloom.llm.shards import read_shards, write_training_order
from spanloom.llm.spelling import one_code_point_lost, spelling_groups, word_counts
from spanloom.llm.suffix import without_repeats
from spanloom.llm.warc import read_warc, write_warc
from spanloom.session import shared_folder

QUERIES, ORACLE = {}, {}


def query(key: str, sql: str | None = None):
    def put(fn):
        QUERIES[key] = fn
        if sql:
            ORACLE[key] = sql
        return fn
    return put


def hex_of(text):
    return F.sha2(F.encode(text, "UTF-8"), 256)


@query("op1_line_dedup", r"""
WITH lines AS (
  SELECT doc_id, i, line, lower_key AS k, length(lower_key) >= 20 AS long_enough
  FROM (SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
        FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
              FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))),
often AS (SELECT k, max(doc_id) AS top FROM lines WHERE long_enough GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM (SELECT doc_id, i, line, o.k IS NOT NULL AND doc_id <> top AS gone FROM lines l LEFT JOIN often o ON l.long_enough AND l.k = o.k)
GROUP BY doc_id""")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    kept = without_repeated_lines(spark.read.parquet(f"{sf}/documents.parquet"))
    return kept.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", hex_of("text").alias("kept_sha256"))


@query("op2_chat_format", r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
each AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         length(role) + length(text) + 17 + len(regexp_extract_all(role || '|' || text, '[<\[]\\*/?(?:s>|INST\])')) AS chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
run AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) + 3 AS upto FROM each)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (role = 'assistant' OR i = n)::BIGINT AS formatted_chars
FROM run GROUP BY conv_id""")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(
        spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string"))
    made = format_chats(turns)
    said = unescaped(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_chars")))
    read = made.select("conv_id", "example", F.length("formatted").alias("chars"), F.when(F.col("loss_chars") > 0, said).otherwise("").alias("loss"),
                       F.when(F.col("last"), parsed(F.col("formatted"))).alias("turns"))
    read = read.groupBy("conv_id").agg(F.max("turns").alias("turns"), F.sum("chars").alias("formatted_chars"),
                                       F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"))
    loss = F.array_join("losses.loss", "")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), hex_of(told).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), hex_of(loss).alias("loss_sha256"), "formatted_chars")


@query("op7_mix_sources", r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS tie FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM rows GROUP BY source),
w AS (SELECT *, (rank % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap FROM s),
lev AS (
  SELECT *, sum(source_size) OVER () - sum(cap) OVER (ORDER BY cap / weight, rank) + cap AS left_over,
         sum(weight) OVER (ORDER BY cap / weight DESC, rank DESC) AS weights_left FROM w),
st AS (SELECT *, cap * weights_left <= left_over * weight AS stopped FROM lev),
one AS (SELECT arg_max(left_over, weights_left) AS l, max(weights_left) AS wl FROM st WHERE NOT stopped),
share AS (SELECT source, source_size, CASE WHEN stopped THEN cap::DOUBLE ELSE weight::DOUBLE * l::DOUBLE / wl::DOUBLE END AS target FROM st, one),
n AS (
  SELECT r.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY r.source ORDER BY size, tie, doc_id) - 1 AS pos,
         ('0x' || substr(md5(coalesce('s' || r.source, '') || '|mix'), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS start
  FROM rows r JOIN share ON r.source IS NOT DISTINCT FROM share.source)
SELECT doc_id, size, source_size, target, (floor((pos + 1) * rate + start)::BIGINT - floor(pos * rate + start)::BIGINT) * size AS taken FROM n""")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf}/documents.parquet"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query("op10_exact_dedup", r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS kept, text_sha256 FROM d""")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    groups = exact_groups(spark.read.parquet(f"{sf}/documents.parquet"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query("op3_bpe")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return bpe_digests(spark.read.parquet(f"{sf}/documents.parquet"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Every row's text encoded and decoded again; equal ids and texts have equal digests."""
    read = round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))
    return read.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
                       hex_of(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), hex_of("text").alias("decoded_sha256"))


@query("op9_near_dedup")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"), width=4).withColumnRenamed("id", "doc_id")


@query("op8_quality")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, learn(docs, labels.where(~held_out("doc_id"))))
    return scored.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op6_ann")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    kept = without_repeats(spark.read.parquet(f"{sf}/documents.parquet"))
    return kept.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_token_shards")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark, "shards")
    write_training_order(spark.read.parquet(f"{sf}/documents.parquet"), folder, ids="text", tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    return read_shards(spark, folder, 256).withColumnRenamed("id", "doc_id")


@query("op12_filter_audit", r"""
WITH words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
first AS (SELECT text, min(doc_id) AS least FROM words GROUP BY text),
said AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * list_unique(w) < 65 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
  FROM words JOIN first USING (text) LEFT JOIN said USING (doc_id)),
counts AS (SELECT part, good, toxic, fails, count(*) AS n FROM judged GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before FROM orders, range(1, 6) t(step)),
hits AS (SELECT *, contains(fails, own) AS here, translate(fails, before, '') <> fails AS early FROM counts, steps),
sums AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT here AND NOT early), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (here AND NOT early), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (here AND early), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (here AND NOT early AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (here AND NOT early AND toxic), 0)::BIGINT AS toxic_lost
  FROM hits GROUP BY ALL)
SELECT * EXCLUDE (own), sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM sums""")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))


@query("op13_spelling_groups", r"""
WITH RECURSIVE table_of AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM runs),
summed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT)),
                     lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS crc FROM bytes, table_of),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN crc % 31 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word FROM summed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT word, n, i, substr(word, 1, i::INT) || substr(word, (i + 2)::INT) AS d FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.d = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.d = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word),
told AS (SELECT w.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
         FROM words w LEFT JOIN best b ON w.word = b.word),
walk AS (SELECT word, word AS root, 0 AS step FROM told UNION ALL SELECT walk.word, form, step + 1 FROM walk JOIN told ON walk.root = told.word WHERE form IS NOT NULL),
ends AS (SELECT word, arg_max(root, step) AS root FROM walk GROUP BY word)
SELECT told.*, root FROM told JOIN ends ON told.word = ends.word""")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return spelling_groups(word_counts(spark.read.parquet(f"{sf}/documents.parquet"), change=one_code_point_lost))


@query("op11_warc", r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
letters AS (SELECT page_id, body, top, list_transform(range(32), lambda i:
              ((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT) AS five FROM p)
SELECT page_id, strlen(body) AS payload_bytes, array_to_string(list_transform(five, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to
FROM letters""")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    write_warc(spark.read.parquet(f"{sf}/pages.parquet"), folder)
    read = read_warc(spark, folder, ["row_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return read.withColumnRenamed("row_id", "page_id")
