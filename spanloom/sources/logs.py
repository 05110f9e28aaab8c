"""Reading detector logs and nested analysis documents into long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import by_width, nxt, ordered_scan, running_sum, spread_join

SPAN = T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())])
WORD = T.StructType([*SPAN.fields, T.StructField("text", T.StringType()),
                     T.StructField("probability", T.DoubleType())])
SEGMENT = T.StructType([*SPAN.fields, T.StructField("text", T.StringType()),
                        T.StructField("words", T.ArrayType(WORD))])
SHOT = T.StructType([*SPAN.fields, *[T.StructField(n, T.DoubleType()) for n in (
    "exposure", "contrast", "blur", "motion", "shake", "warmth")]])
SOUND = T.StructType([*SPAN.fields, *[T.StructField(n, T.DoubleType()) for n in (
    "loudness", "peak", "noise_floor", "flatness")], T.StructField("momentary", T.ArrayType(T.DoubleType()))])
ANALYSIS = T.StructType([
    T.StructField("asset_id", T.StringType()), T.StructField("duration", T.DoubleType()),
    *[T.StructField(n, T.ArrayType(SPAN)) for n in ("scenes", "black_frames", "frozen_frames", "silences")],
    T.StructField("shots", T.ArrayType(SHOT)), T.StructField("sound", T.ArrayType(SOUND)),
    T.StructField("transcript", T.StructType([T.StructField("segments", T.ArrayType(SEGMENT))])),
])


def read_analyses(spark: SparkSession, path: str) -> DataFrame:
    """Nested analysis documents, one JSON object a line, with a declared schema."""
    return spark.read.schema(ANALYSIS).json(path)


def parse_analyses(texts: DataFrame, text: str) -> DataFrame:
    """Documents kept as JSON text, one row each, as columns of their declared schema. Text that is no document gives nulls."""
    return texts.select(F.from_json(text, ANALYSIS).alias("d")).select("d.*")


def part_states(texts: DataFrame, text: str, parts: Sequence[str]) -> DataFrame:
    """Whether a document has each part: key, part and state, which is absent, null, empty or filled. A document without a part was
    never looked at for it, which is not the same as nothing having been found."""
    held = texts.select(F.get_json_object(text, "$.asset_id").alias("key"), F.json_object_keys(text).alias("keys"), F.col(text).alias("__text"))
    state = lambda p: (F.when(~F.array_contains("keys", p), "absent").when(F.get_json_object("__text", f"$.{p}").isNull(), "null")
                       .when(F.json_array_length(F.get_json_object("__text", f"$.{p}")) == 0, "empty").otherwise("filled"))
    return held.where("keys is not null").select("key", F.inline(F.array(*[F.struct(F.lit(p).alias("part"), state(p).alias("state")) for p in parts])))


def flatten_analyses(docs: DataFrame) -> dict[str, DataFrame]:
    """The long tables held in nested analyses; each prunes to the part of the document it needs."""
    kinds = {"scenes": "scene", "black_frames": "black", "frozen_frames": "frozen", "silences": "silence"}
    key = F.col("asset_id").alias("key")

    def named(column, kind):
        held = F.coalesce(F.col(column), F.array().cast(T.ArrayType(SPAN)))
        return F.transform(held, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    tagged = F.concat(*[named(c, k) for c, k in kinds.items()])
    segments = docs.select(key, F.posexplode("transcript.segments").alias("seg", "x")).select(
        "key", "seg", "x.start", "x.end", "x.text", "x.words")
    return {
        "spans": docs.select(key, F.inline(tagged)),
        "shots": docs.select(key, F.inline("shots")),
        "sound": docs.select(key, F.inline("sound")),
        "segments": segments.drop("words"),
        "words": segments.select("key", "seg", F.posexplode("words").alias("idx", "w")).select(
            "key", "seg", "idx", "w.start", "w.end", "w.text", F.col("w.probability").alias("prob")),
    }


def pair_events(
    log: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, kind: str, at: str,
    start: str, end: str, until: DataFrame | None = None, fin: str = "fin",
) -> DataFrame:
    """Pair each start with the end that follows it; a start followed by another start is forgotten, and one
    nothing follows runs to ``fin`` of its key."""
    marks = log.where(F.col(kind).isin(start, end))
    seen = ordered_scan(marks, keys, order, chunk, {"__k": nxt(F.col(kind)), "__t": nxt(F.col(at))})
    opened = seen.where((F.col(kind) == start) & (F.col("__k").isNull() | (F.col("__k") == end)))
    if until is not None:
        opened = spread_join(opened, until, keys, "left")
    closes = F.coalesce(F.col("__t"), F.col(fin)) if until is not None else F.col("__t")
    return opened.select(*keys, F.col(at).alias("s"), closes.alias("e")).where(
        F.col("e").isNull() | (F.col("e") > F.col("s")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their place: file, block, pos, line. Splits stay splits; a file is never one row."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))


def frame_records(lines: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column) -> DataFrame:
    """Fold ``frame:`` headers and the ``name=value`` lines after them into records.

    Gives keys, rec, seconds and values (a map). A value that is no finite number is dropped; a record all
    of whose values were is kept, empty.
    """
    keys = list(keys)
    header = F.col("line").startswith("frame:")
    seconds = F.expr(r"try_cast(regexp_extract(line, 'pts_time:(-?[\\d.]+)', 1) AS double)")
    name = F.regexp_extract("line", r"^\s*([^=]*)=", 1)
    number = F.expr(r"try_cast(regexp_extract(line, '=(.*)$', 1) AS double)")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    d = lines.withColumn("__h", header.cast("long"))
    d = ordered_scan(d, keys, order, chunk, {"rec": running_sum(F.col("__h"))}).where(F.col("rec") > 0)
    at = F.struct(*order)
    # A repeated name keeps its last value.
    one = d.where((F.col("__h") == 0) & finite).groupBy(*keys, "rec", name.alias("__n")).agg(
        F.max_by(number, at).alias("__v"))
    values = one.groupBy(*keys, "rec").agg(F.map_from_entries(F.collect_list(F.struct("__n", "__v"))).alias("values"))
    heads = d.where(F.col("__h") == 1).select(*keys, "rec", F.coalesce(seconds, F.lit(0.0)).alias("seconds"))
    return heads.join(values, [*keys, "rec"], "left").withColumn(
        "values", F.coalesce("values", F.expr("map_from_arrays(array(), array())").cast("map<string,double>")))
