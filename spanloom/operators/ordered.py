"""Ordered scans that never put a whole key into one task.

A plain window over ``PARTITION BY key`` sends every row of a key to one task, and one key may hold a
third of the data. Here the rows are dealt into ranges of ``(key, order)`` whose bounds are sampled from the
rows themselves, so a range holds a like number of rows however dense a key is. A key's rows in one
range are a chunk. The window runs inside ``(key, chunk)``; each chunk is also reduced to one summary row with
map-side combining, the summaries are scanned per key (one row per chunk, not per row), and what they
carry in from earlier or later chunks is joined back on ``(key, chunk)``, null keys included.

The dealt rows are written once to the checkpoint folder, so both uses of them see the same ranges and read the input
once, and a lost executor costs nothing that was dealt. Nothing is cached: a scan reads its input when it is called.
``spark.cleaner.referenceTracking.cleanCheckpoints`` lets Spark delete what no plan refers to any more.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_CHUNK = "__chunk"


@dataclass(frozen=True)
class Out:
    """One output of an ordered scan: what it carries, over which expression, with or without the own row."""

    kind: str
    expr: Column
    inclusive: bool = False


def prev(expr: Column) -> Out:
    """The value on the row before."""
    return Out("prev", expr)


def nxt(expr: Column) -> Out:
    """The value on the row after."""
    return Out("next", expr)


def running_sum(expr: Column, inclusive: bool = True) -> Out:
    return Out("sum", expr, inclusive)


def running_max(expr: Column, inclusive: bool = True) -> Out:
    return Out("max", expr, inclusive)


def running_min(expr: Column, inclusive: bool = True) -> Out:
    return Out("min", expr, inclusive)


def last_value(expr: Column, inclusive: bool = True) -> Out:
    """The latest non-null value up to this row."""
    return Out("last", expr, inclusive)


def first_value(expr: Column, inclusive: bool = True) -> Out:
    """The earliest non-null value from this row on."""
    return Out("first", expr, inclusive)


def row_number() -> Out:
    return Out("sum", F.lit(1).cast("long"), True)


def total_sum(expr: Column) -> Out:
    """The sum over the whole key, carried in with the chunk summaries instead of joined on the key."""
    return Out("total_sum", expr)


def total_max(expr: Column) -> Out:
    return Out("total_max", expr)


def spread_join(detail: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner", salts: int = 16,
                null_safe: bool = False) -> DataFrame:
    """Join rows to a table of one row per key without sending a key's rows to one task.

    Both sides get a salt: the small side once per salt, the rows by their own content. Nothing after the
    join can rely on its partitioning by key, so AQE is also free to split whatever is still skewed. With ``null_safe``
    null keys meet null keys.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    hashed = [c for c, kind in detail.dtypes if "map<" not in kind]
    d = detail.withColumn("__salt", F.pmod(F.xxhash64(*hashed), F.lit(salts)).cast("int"))
    s = per_key.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    if not null_safe:
        return d.join(s, [*keys, "__salt"], how).drop("__salt")
    s = s.withColumnsRenamed({k: f"__k_{i}" for i, k in enumerate([*keys, "__salt"])})
    same = F.lit(True)
    for i, k in enumerate([*keys, "__salt"]):
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{i}"))
    return d.join(s, same, how).drop("__salt", *[f"__k_{i}" for i in range(len(keys) + 1)])


def by_width(column: str, width: int) -> Column:
    """A chunk number that rises with a whole-number column."""
    return F.expr(f"`{column}` div {int(width)}")


def ordered_scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, outs: Mapping[str, Out],
) -> DataFrame:
    """Add running and neighbouring values per key in the given order.

    ``order`` has to be a total order within a key; nulls come first, and rows with a null key are a key like
    any other. ``chunk`` rises with the first order column; it is only a hint, the ranges are found by sampling.
    """
    return _scanned(_dealt(df, keys, order), keys, order, outs).drop(_CHUNK)


def _dealt(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows in ranges of (keys, order), with the number of their range."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(ranges, *keys, *order).withColumn(_CHUNK, F.spark_partition_id()))


def _scanned(d: DataFrame, keys: Sequence[str], order: Sequence[str], outs: Mapping[str, Out]) -> DataFrame:
    """One scan over dealt rows, which stay dealt: the range's number is a stored column."""
    keys, order = list(keys), list(order)
    at = F.struct(*order)
    aggs, carries = [], []
    up = Window.partitionBy(*keys).orderBy(_CHUNK)
    down = Window.partitionBy(*keys).orderBy(F.col(_CHUNK).desc())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = down.rowsBetween(Window.unboundedPreceding, -1)
    for name, o in outs.items():
        a, c = f"__a_{name}", f"__c_{name}"
        held = F.when(o.expr.isNotNull(), at)
        if o.kind == "prev":
            aggs.append(F.max_by(o.expr, at).alias(a))
            carries.append(F.lag(a).over(up).alias(c))
        elif o.kind == "next":
            aggs.append(F.min_by(o.expr, at).alias(a))
            carries.append(F.lead(a).over(up).alias(c))
        elif o.kind == "last":
            aggs.append(F.max_by(o.expr, held).alias(a))
            carries.append(F.last(a, True).over(before).alias(c))
        elif o.kind == "first":
            aggs.append(F.min_by(o.expr, held).alias(a))
            carries.append(F.last(a, True).over(after).alias(c))
        elif o.kind.startswith("total_"):
            fn = F.sum if o.kind == "total_sum" else F.max
            aggs.append(fn(o.expr).alias(a))
            carries.append(fn(a).over(Window.partitionBy(*keys)).alias(c))
        else:
            fn = {"sum": F.sum, "max": F.max, "min": F.min}[o.kind]
            aggs.append(fn(o.expr).alias(a))
            carries.append(fn(a).over(before).alias(c))
    summary = d.groupBy(*keys, _CHUNK).agg(*aggs).select(*keys, _CHUNK, *carries)
    # Null-safe on the keys; their order columns take no part.
    carried = summary.select(*[F.col(k).alias(f"__k_{i}") for i, k in enumerate(keys)], F.col(_CHUNK).alias("__at_chunk"),
                             *[f"__c_{name}" for name in outs])
    same = F.col(_CHUNK) == F.col("__at_chunk")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{i}"))
    joined = d.join(carried, same)

    inside = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    backward = Window.partitionBy(*keys, _CHUNK).orderBy(*[F.col(c).desc() for c in order])
    columns = []
    for name, o in outs.items():
        c = F.col(f"__c_{name}")
        frame = inside.rowsBetween(Window.unboundedPreceding, 0 if o.inclusive else -1)
        if o.kind == "prev":
            value = F.when(F.row_number().over(inside) == 1, c).otherwise(F.lag(o.expr).over(inside))
        elif o.kind == "next":
            value = F.when(F.lead(F.lit(1)).over(inside).isNull(), c).otherwise(F.lead(o.expr).over(inside))
        elif o.kind == "last":
            value = F.coalesce(F.last(o.expr, True).over(frame), c)
        elif o.kind == "first":
            ahead = backward.rowsBetween(Window.unboundedPreceding, 0 if o.inclusive else -1)
            value = F.coalesce(F.last(o.expr, True).over(ahead), c)
        elif o.kind.startswith("total_"):
            value = c
        elif o.kind == "sum":
            value = F.coalesce(c, F.lit(0)) + F.coalesce(F.sum(o.expr).over(frame), F.lit(0))
        elif o.kind == "max":
            value = F.greatest(c, F.max(o.expr).over(frame))
        else:
            value = F.least(c, F.min(o.expr).over(frame))
        columns.append(value.alias(name))
    return joined.select(*d.columns, *columns)


def islands(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
    look: Mapping[str, Out], starts: Column, name: str = "grp",
) -> DataFrame:
    """Number the runs of a sequence: ``look`` adds what the rule needs, ``starts`` says where a run begins.

    The first row of a key begins one whatever the rule answers, so a rule that reads a missing neighbour
    as NULL is enough.
    """
    seen = _scanned(_dealt(df, keys, order), keys, order, look)
    flagged = seen.withColumn("__new", F.coalesce(starts, F.lit(True)).cast("long"))
    return _scanned(flagged, keys, order, {name: running_sum(F.col("__new"))}).drop("__new", _CHUNK)


def rank_picks(
    df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, Column], width: float,
) -> DataFrame:
    """The values at given ranks (from 0, as expressions over ``__total``) of each key's sorted values.

    Exact, without gathering a group: equal values are counted first (map-side combined), the counts are run
    up in value order in chunks of ``width``, and only the values at the ranks are picked out. A rank past
    the end, or NULL, picks NULL.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    run = ordered_scan(counts, keys, [value], F.floor(F.col(value) / F.lit(width)),
                       {"__to": running_sum(F.col("__n")), "__total": total_sum(F.col("__n"))})
    first, past = F.col("__to") - F.col("__n"), F.col("__to")
    picked = [F.max(F.when((first <= at) & (at < past), F.col(value))).alias(name) for name, at in ranks.items()]
    return run.groupBy(*keys, "__total").agg(*picked)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], width: float,
) -> DataFrame:
    """Linearly interpolated quantiles per key; see ``rank_picks`` for how. The two neighbours are weighed, not one moved towards the other, so
    that a middle value lies equally far from both where their distance rounds."""
    ranks, result = {}, []
    for name, p in probs.items():
        rank = F.lit(p) * (F.col("__total") - 1)
        ranks |= {f"__lo_{name}": F.floor(rank), f"__hi_{name}": F.ceil(rank)}
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        past = rank - F.floor(rank)
        result.append((lo * (1 - past) + hi * past).alias(name))
    return rank_picks(df, keys, value, ranks, width).select(*keys, *result)
