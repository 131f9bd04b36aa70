"""Exact quantiles with linear interpolation, in bounded memory.

Spark's ``percentile`` keeps every distinct value of a group in one task. Here the distinct values of
all columns asked for, with their counts, are dealt into ranges that Spark samples from the
values themselves, so their spread doesn't matter: one value may be 1e300 or infinite and a million
others close together. Counts per range tell in which range each wanted rank lies, and only these
ranges are looked at once more. A range holds about ``range_rows`` values; where that would make more than
``_MOST_SMALL`` ranges, it holds up to ``_TASK_ROWS``, as each range is a task. All columns share the passes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.session import durable

_RANGE_ROWS = 50_000
_MOST_SMALL = 200
_TASK_ROWS = 500_000


def range_count(values: int, range_rows: int) -> int:
    """Ranges for so many distinct values: small ones while they are few, then no more than tasks of full size need."""
    wanted = -(-values // range_rows)
    return max(1, min(wanted, max(_MOST_SMALL, -(-values // _TASK_ROWS))))


def rank_quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]], range_rows: int = _RANGE_ROWS) -> DataFrame:
    """Rows ``(feature, prob, value)``: numpy-style linear quantiles of numeric columns.

    Null and NaN are left out; of no values at all every quantile is null. The values are
    written to the checkpoint folder, so the rows behind them are computed once.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in wanted])
    long = df.select(F.explode(cells).alias("f")).select("f.feature", "f.x").filter(F.col("x").isNotNull() & ~F.isnan("x"))
    values = durable(long.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n")))
    parts = range_count(values.count(), range_rows)
    laid = values.repartitionByRange(parts, "feature", "x").withColumn("part", F.spark_partition_id())
    laid = durable(laid)

    of_feature = Window.partitionBy("feature")
    ranges = laid.groupBy("feature", "part").agg(F.sum("n").alias("n"))
    # one row for each feature and range
    ranges = ranges.withColumns(
        {
            "total": F.sum("n").over(of_feature),
            "before": F.sum("n").over(of_feature.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"),
        }
    )
    probs = F.create_map(
        *[x for c, ps in wanted.items() for x in (F.lit(c), F.array(*[F.lit(float(p)) for p in ps]).cast("array<double>"))]
    )
    # each quantile needs the two order statistics around p * (total - 1)
    at = F.col("prob") * (F.col("total") - 1)
    asked = ranges.withColumn("prob", F.explode(F.array_distinct(probs[F.col("feature")])))
    ends = F.array(*[F.struct(F.lit(i).alias("side"), c(at).cast("bigint").alias("rank")) for i, c in enumerate((F.floor, F.ceil))])
    asked = asked.withColumn("end", F.explode(ends)).filter("end.rank >= before AND end.rank < before + n")
    frac = (at - F.floor(at)).alias("frac")
    asked = asked.select("feature", "part", F.struct("prob", "end.side", (F.col("end.rank") - F.col("before")).alias("rank"), frac).alias("w"))
    wants = asked.groupBy("feature", "part").agg(F.collect_list("w").alias("wants"))  # two for each quantile at most

    hit = laid.join(wants, ["feature", "part"])
    before = Window.partitionBy("feature", "part").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = hit.withColumn("upto", F.sum("n").over(before))
    inside = F.filter("wants", lambda w: (w["rank"] < F.col("upto")) & (w["rank"] >= F.col("upto") - F.col("n")))
    found = hit.select("feature", "x", F.explode(inside).alias("w"))
    sides = found.groupBy("feature", "w.prob").agg(
        F.max(F.when(F.col("w.side") == 0, F.col("x"))).alias("below"),
        F.max(F.when(F.col("w.side") == 1, F.col("x"))).alias("above"),
        F.max("w.frac").alias("frac"),
    )
    below, above, frac = F.col("below"), F.col("above"), F.col("frac")
    value = F.when((frac == 0) | (below == above), below).otherwise(below + (above - below) * frac)
    every = [(c, float(p)) for c, ps in wanted.items() for p in dict.fromkeys(ps)]
    names = df.sparkSession.createDataFrame(every, "feature string, prob double")
    return names.join(sides.select("feature", "prob", value.alias("value")), ["feature", "prob"], "left")


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float], range_rows: int = _RANGE_ROWS) -> DataFrame:
    """Rows ``(prob, value)`` of one column."""
    return rank_quantiles(df, {column: probs}, range_rows).select("prob", "value")


def quantile_row(df: DataFrame, column: str, named: dict[str, float]) -> DataFrame:
    """One row with a column per named quantile."""
    names = list(named)
    found = exact_quantiles(df, column, [named[n] for n in names])
    return found.agg(*[F.max(F.when(F.col("prob") == F.lit(float(named[n])), F.col("value"))).alias(n) for n in names])
