"""Names in a prompt: where doubtful speech sounds like one, and which are never said."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import blurred


def sound_alikes(units: DataFrame, keys: Sequence[str], pos: str, unit: str, unsure: str, names: DataFrame, readings: DataFrame) -> DataFrame:
    """Stretches with something doubtful in them that read like a name but do not say it.

    ``units`` are the characters (or words) of a run in order, ``names`` is (name, k, unit) and ``readings``
    is (unit, reading). Every unit of a name joins the units that sound like it, and a stretch counts when
    all of the name's units met it at the same start: equality joins and a count, no windows tried.
    """
    keys = list(keys)
    size = names.groupBy("name").agg(F.count(F.lit(1)).alias("__size"))
    n = names.join(readings, "unit").select("name", "k", F.col("unit").alias("__want"), F.col("reading").alias("__r"), blurred(F.col("reading")).alias("__b"))
    u = units.join(readings.withColumnRenamed("unit", unit), unit).withColumn("__b", blurred(F.col("reading")))
    met = u.join(n, "__b").withColumn("start", F.col(pos) - F.col("k")).groupBy(*keys, "start", "name", "k").agg(
        F.max(F.col("reading") == F.col("__r")).alias("exact"), F.max(F.col(unit) == F.col("__want")).alias("same"),
        F.max(unsure).alias("unsure"))
    whole = met.groupBy(*keys, "start", "name").agg(
        F.count(F.lit(1)).alias("__n"), F.min("exact").alias("exact"), F.min("same").alias("same"), F.max("unsure").alias("unsure"))
    return whole.join(size, "name").where((F.col("__n") == F.col("__size")) & ~F.col("same") & F.col("unsure")).select(*keys, "start", "name", "exact")


_RUN = r"[\p{L}\p{N}'-]+"


def missing_terms(texts: DataFrame, text: str, terms: DataFrame, term: str) -> DataFrame:
    """Terms that no text contains, spaces and punctuation inside a term included; case does not count.

    Most terms are one run of word characters, and only the distinct runs (or, of terms without any, the distinct
    stretches between runs) matter for those. A term of several runs lies in as many neighbouring runs of a text and what is around
    them, and its first run ends the first of those: distinct stretches of that many runs meet the terms by an equality
    join, so no text is held once a run.
    """
    low = F.lower(text)
    held = terms.select(term, F.lower(term).alias("__t"), F.regexp_extract(F.lower(term), _RUN, 0).alias("__first"))

    def stretches(pattern):
        return texts.select(F.explode(F.regexp_extract_all(low, F.lit(pattern), F.lit(0))).alias("__r")).distinct()

    def inside(some, pool):
        # One row a length, and stretches are short, so each gives few substrings.
        sizes = some.select(F.length("__t").alias("__n")).distinct()
        at = pool.join(F.broadcast(sizes), F.length("__r") >= F.col("__n")).select(
            F.explode(F.expr("transform(sequence(1, length(__r) - __n + 1), i -> substring(__r, i, __n))")).alias("__t")).distinct()
        return some.join(at, "__t", "left_semi").select("__t")
    runs = stretches(_RUN)
    whole, bare = F.col("__first") == F.col("__t"), F.col("__first") == ""
    plain = held.where(whole).join(runs.withColumnRenamed("__r", "__t"), "__t", "left_anti")
    found = inside(plain, runs).unionByName(inside(held.where(bare & (F.col("__t") != "")), stretches(r"[^\p{L}\p{N}'-]+")))
    # Terms of several runs, or with something before their first.
    mixed = held.where(~whole & ~bare)
    mixed = mixed.withColumn("__k", F.size(F.regexp_extract_all("__t", F.lit(_RUN), F.lit(0))))
    ends = runs.join(F.broadcast(mixed.select(F.length("__first").alias("__n")).distinct()), F.length("__r") >= F.col("__n"))
    ends = ends.select("__r", F.expr("right(__r, __n)").alias("__first")).join(mixed, "__first").select("__r", "__k", "__t")
    cut = texts.select(F.regexp_extract_all(low, F.lit(_RUN), F.lit(0)).alias("__w"), F.split(low, _RUN, -1).alias("__b"))
    cut = cut.join(F.broadcast(mixed.select("__k").distinct()), F.size("__w") >= F.col("__k"))
    around = "concat(__b[i], array_join(transform(sequence(i, i + __k - 1), j -> concat(__w[j], __b[j + 1])), ''))"
    near = cut.select("__k", F.inline(F.array_distinct(F.expr(f"transform(sequence(0, size(__w) - __k), i -> struct(__w[i] AS __r, {around} AS __a))"))))
    # An exploded side looks smaller than it is, so the join is never left to a broadcast.
    found = found.unionByName(near.distinct().hint("merge").join(ends, ["__r", "__k"]).where(F.col("__a").contains(F.col("__t"))).select("__t"))
    known = held.where(whole).join(runs.withColumnRenamed("__r", "__t"), "__t", "left_semi").select("__t")
    return held.where(F.col("__t") != "").join(found.unionByName(known).distinct(), "__t", "left_anti").select(term)
