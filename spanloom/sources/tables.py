"""Loaders for the supplied tables and the canonical shapes derived from them.

Times are whole microseconds (``bigint``), so that sums and differences are exact and the order of a
reduction cannot change a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import by_width, nxt, ordered_scan, running_sum

SECOND = 1_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR
# Rows of one key are scanned in pieces this long; the hottest key sets it.
CHUNK = DAY
# Bin of the interval joins: about the usual length of a span.
BIN = 6 * HOUR
EPOCH = 1_704_067_200 * SECOND  # 2024-01-01


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A supplied table. Its times carry no zone and are read as UTC, which is the session's zone from here on."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros(column: str):
    """Microseconds of a timestamp, with or without a zone, in a UTC session."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def events(spark, sf) -> DataFrame:
    """key, id, kind, value, t, props"""
    return load(spark, sf, "events").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"),
        "value", micros("ts").alias("t"), "props")


def spans_a(spark, sf) -> DataFrame:
    """Stretches from one event of a user to the next: key, id, kind, value, s, e."""
    ev = events(spark, sf).drop("props")
    seen = ordered_scan(ev, ["key"], ["t", "id"], by_width("t", CHUNK), {"e": nxt(F.col("t"))})
    return seen.where(F.col("e").isNotNull()).select("key", "id", "kind", "value", F.col("t").alias("s"), "e")


def spans_b(spark, sf, names=("bs", "be"), ident="bid") -> DataFrame:
    """Purchases, each lasting ten minutes a unit of value; they overlap: key, bid, bs, be, bvalue."""
    ev = events(spark, sf).where(F.col("kind") == "purchase")
    return ev.select("key", F.col("id").alias(ident), F.col("t").alias(names[0]),
                     (F.col("t") + F.round(F.col("value") * 600 * SECOND).cast("long")).alias(names[1]),
                     F.col("value").alias("bvalue"))


def moments(spark, sf, kind="error") -> DataFrame:
    """key, pid, t"""
    return events(spark, sf).where(F.col("kind") == kind).select("key", F.col("id").alias("pid"), "t")


def series(spark, sf) -> DataFrame:
    """Hourly levels per event type: key, sec (hours since the epoch of the data), loudness, peak, n."""
    ev = events(spark, sf)
    return ev.groupBy(F.col("kind").alias("key"), F.expr(f"(t - {EPOCH}) div {HOUR}").alias("sec")).agg(
        F.round(-20 - F.avg("value") / 9.7, 7).alias("loudness"), F.max("value").alias("peak"),
        F.count(F.lit(1)).alias("n"))


def placements(spark, sf) -> DataFrame:
    """Stretches laid end to end per user, clicks at double speed: key, id, kind, s, e, speed, tl, tle, pos."""
    a = spans_a(spark, sf).withColumn("speed", F.when(F.col("kind") == "click", 2).otherwise(1).cast("long"))
    a = a.withColumn("len", F.expr("(e - s) div speed"))
    out = ordered_scan(a, ["key"], ["s", "id"], by_width("s", CHUNK), {
        "tl": running_sum(F.col("len"), inclusive=False), "pos": running_sum(F.lit(1).cast("long"))})
    return out.select("key", "id", "kind", "value", "s", "e", "speed", "tl",
                      (F.col("tl") + F.col("len")).alias("tle"), "pos")


def clips(spark, sf) -> DataFrame:
    """Documents as searchable clips, one second of start per id and fifteen characters a second.

    id, key, level, kind, s, e, text, description (NULL for one language), tags, scores (a map in which a
    missing label is an absent score).
    """
    d = load(spark, sf, "documents")
    lab = load(spark, sf, "labels")
    j = d.join(lab, "doc_id", "left")
    scores = F.map_filter(
        F.create_map(
            F.lit("length"), F.col("n_chars").cast("double"),
            F.lit("quality"), F.col("quality").cast("double"),
            F.lit("toxic"), F.col("toxic").cast("double")),
        lambda k, v: v.isNotNull())
    tags = F.filter(F.array(
        F.struct(F.col("lang").alias("value"), F.lit("language").alias("source")),
        F.struct(F.when(F.col("quality") == 1, "good").alias("value"), F.lit("label").alias("source")),
        F.struct(F.when(F.col("toxic") == 1, "toxic").alias("value"), F.lit("label").alias("source")),
    ), lambda x: x["value"].isNotNull())
    return j.select(
        F.col("doc_id").alias("id"), F.col("source").alias("key"),
        F.when(F.col("n_chars") >= 2000, "section").otherwise("utterance").alias("level"),
        F.when(F.col("lang") == "en", "speech").when(F.col("lang") == "fr", "ambient")
        .when(F.col("lang") == "de", "silence").otherwise("action").alias("kind"),
        F.col("doc_id").cast("double").alias("s"),
        (F.col("doc_id") + F.col("n_chars") / F.lit(15.0)).alias("e"),
        "text", F.when(F.col("lang") != "de", F.col("source")).alias("description"),
        tags.alias("tags"), scores.alias("scores"))


def sentences(spark, sf) -> DataFrame:
    """Documents split after sentence ends and at line breaks: key, seg, text, s, e (microseconds).

    Blank pieces are left out; positions are running character counts at fifteen a second.
    """
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("key"), "text")
    pieces = d.select("key", F.expr(r"posexplode(split(text, '(?<=[.!?])|\\n', -1))").alias("seg", "text"))
    pieces = pieces.withColumn("len", F.length("text").cast("long"))
    run = ordered_scan(pieces, ["key"], ["seg"], by_width("seg", 10_000),
                       {"c": running_sum(F.col("len"), inclusive=False)})
    per = SECOND // 15
    return run.where(F.trim("text") != "").select(
        "key", F.col("seg").cast("long").alias("seg"), F.trim("text").alias("text"),
        (F.col("c") * per).alias("s"), ((F.col("c") + F.col("len")) * per).alias("e"))


def words(spark, sf, only=("turn", "idx", "speaker", "text"), **more) -> DataFrame:
    """Words of the conversations: key (conversation), turn, idx, speaker, text, s, e, prob.

    ``only`` says which of the columns besides key, ord and the times are wanted, and ``more`` adds expressions over the word; nothing
    else goes through the scan.

    A word lasts as long as it has letters, so bare punctuation has no length; a turn starts where the
    one before it ended, plus a second for every three characters over a hundred in it.
    """
    c = load(spark, sf, "conversations").select(F.col("conv_id").alias("key"), "turn", "role", "text")
    w = c.select("key", "turn", F.col("role").alias("speaker"),
                 F.expr(r"posexplode(split(text, '\\s+', -1))").alias("idx", "text"))
    w = w.where(F.col("text") != "").withColumn("ord", F.col("turn") * 1_000_000 + F.col("idx"))
    letters = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", "")).cast("long")
    stop = F.when(F.col("text").rlike(r"[.!?]$"), 9).when(F.col("text").rlike(r"[,;:]$"), 4).otherwise(1).cast("long")
    w = w.withColumn("letters", letters).withColumn("step", F.col("letters") + stop)
    w = w.withColumn("idx", F.col("idx").cast("long")).withColumns(more).select("key", "ord", "letters", "step", *only, *more)
    run = ordered_scan(w, ["key"], ["ord"], by_width("ord", 1_000_000),
                       {"c": running_sum(F.col("step"), inclusive=False)})
    per = SECOND // 15
    told = [c for c in ("key", "turn", "idx", "ord", "speaker", "text") if c in run.columns]
    return run.select(
        *told, *more, (F.col("c") * per).alias("s"), ((F.col("c") + F.col("letters")) * per).alias("e"),
        F.when(F.col("letters") > 0, F.lit(1.0) / F.col("letters")).otherwise(F.lit(0.01)).alias("prob"))


def turns(spark, sf, **more) -> DataFrame:
    """Speaker turns of the conversations, fifteen characters a second: key, turn, speaker, text, s, e, and what else the scan is to add."""
    c = load(spark, sf, "conversations").select(
        F.col("conv_id").alias("key"), "turn", F.col("role").alias("speaker"), "text",
        F.length("text").cast("long").alias("len"))
    run = ordered_scan(c, ["key"], ["turn"], by_width("turn", 10_000),
                       {"c": running_sum(F.col("len"), inclusive=False), **more})
    per = SECOND // 15
    return run.select("key", "turn", "speaker", "text", (F.col("c") * per).alias("s"),
                      ((F.col("c") + F.col("len")) * per).alias("e"), *more)


def order_versions(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of the orders: the later has lost the finished ones, gained the pending ones, and has
    urgent ones repriced and high ones handed to another customer."""
    o = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    before = o.where(F.col("status") != "P")
    after = o.where(F.col("status") != "F").withColumn(
        "price", F.when(F.col("priority") == "1-URGENT", F.col("price") + 1.0).otherwise(F.col("price"))).withColumn(
        "cust", F.when(F.col("priority") == "2-HIGH", F.col("cust") + 1).otherwise(F.col("cust")))
    return before, after
