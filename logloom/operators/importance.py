"""Which features set the flagged rows apart."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.quantiles import rank_quantiles
from logloom.session import durable

_EPS = 1e-8


def statistical_importance(df: DataFrame, flag: str, features: Sequence[str]) -> DataFrame:
    """``mean_diff * (1 + |std_ratio - 1|) * cohens_d`` of standardised features.

    All moments come from one aggregate over the wide rows; nothing is unpivoted
    before it is aggregated.
    """
    on = F.col(flag)
    aggs = []
    for f in features:
        x = F.col(f).cast("double")
        aggs.append(
            F.struct(
                F.stddev_pop(x).alias("sd"),
                F.avg(F.when(on, x)).alias("ma"),
                F.avg(F.when(~on, x)).alias("mn"),
                F.stddev_samp(F.when(on, x)).alias("sa"),
                F.stddev_samp(F.when(~on, x)).alias("sn"),
                F.count(F.when(on, x)).alias("na"),
                F.count(F.when(~on, x)).alias("nn"),
            ).alias(f)
        )
    s = F.col("s")
    long = df.agg(*aggs).unpivot([], list(features), "feature", "s").filter(s["sd"] > 0)
    sa, sn = s["sa"] / s["sd"], s["sn"] / s["sd"]
    pooled = F.sqrt(
        ((s["na"] - 1) * sa * sa + (s["nn"] - 1) * sn * sn) / (s["na"] + s["nn"] - 2)
    )
    return (
        long.withColumn("mean_diff", F.abs(s["ma"] - s["mn"]) / s["sd"])
        .withColumn("std_ratio", sa / (sn + _EPS))
        .withColumn("cohens_d", F.col("mean_diff") / (pooled + _EPS))
        .select(
            "feature",
            (F.col("mean_diff") * (1 + F.abs(F.col("std_ratio") - 1)) * F.col("cohens_d")).alias("importance"),
            "mean_diff", "std_ratio", "cohens_d",
        )
    )


def extreme_importance(
    df: DataFrame, flag: str, features: Sequence[str], low: float = 0.1, high: float = 0.9
) -> DataFrame:
    """``P(flag | extreme) - P(flag)``; extreme is outside the outer quantiles."""
    on = F.col(flag).cast("int")
    ends = {f: {} for f in features}
    for r in rank_quantiles(df, {f: (low, high) for f in features}).collect():  # two rows a feature
        ends[r["feature"]][r["prob"]] = r["value"]
    aggs = [F.avg(on).alias("overall")]
    for f in features:
        extreme = (F.col(f) < F.lit(ends[f][low])) | (F.col(f) > F.lit(ends[f][high]))
        aggs.append(F.avg(F.when(extreme, on)).alias(f))
    wide = df.agg(*aggs)
    return wide.unpivot(["overall"], list(features), "feature", "extreme_anomaly_rate").select(
        "feature",
        (F.col("extreme_anomaly_rate") - F.col("overall")).alias("contribution"),
        "extreme_anomaly_rate",
        F.col("overall").alias("overall_anomaly_rate"),
    )


def permuted(df: DataFrame, key: str, features: Sequence[str], seed: int, range_rows: int = 50_000) -> DataFrame:
    """``df`` with ``p_<feature>`` columns: the features of another row, a permutation of all rows.

    Rows are put in the order of a hash of seed and key, and each takes the values of the next one, the last
    those of the first. Ranges of the order are tasks; what the last row of a range takes comes from the first
    of the next. The permutation is the same however many ranges there are.
    """
    name = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    parts = max(1, -(-df.count() // range_rows))
    order = ["__h", key]
    laid = df.withColumn("__h", name).repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    laid = durable(laid)
    boxed = F.struct(*features)
    # one row for each range: the first row of the next one, and of the first one for the last
    firsts = laid.groupBy("__part").agg(F.min_by(boxed, F.struct(*order)).alias("first"))
    by_part = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    over = F.coalesce(F.lead("first").over(Window.orderBy("__part")), F.first("first").over(by_part))
    firsts = firsts.select("__part", over.alias("__over"))
    following = F.lead(boxed).over(Window.partitionBy("__part").orderBy(*order))
    taken = laid.withColumn("__next", following).join(firsts, "__part")
    taken = taken.withColumn("__next", F.coalesce("__next", "__over"))
    return taken.select(*df.columns, *[F.col("__next")[f].alias(f"p_{f}") for f in features])


def permutation_importance(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    score: Callable[[DataFrame], DataFrame],
    repeats: int = 3,
    seed: int = 11,
    range_rows: int = 50_000,
) -> DataFrame:
    """Mean and deviation over repeats of the mean score change when a feature is permuted.

    ``score`` adds a column ``score`` to rows with the features; ``key`` tells the rows apart. A repeat
    orders the rows once for all features.
    """
    df = durable(df)
    base = score(df).agg(F.avg("score").alias("m")).first()["m"]
    parts = None
    for r in range(repeats):
        mixed = durable(permuted(df, key, features, seed + r, range_rows))
        for f in features:
            one = mixed.withColumn(f, F.col(f"p_{f}")).select(*df.columns)
            change = F.abs(F.avg("score") - F.lit(base)).alias("change")
            one = score(one).agg(F.lit(f).alias("feature"), change)
            parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("feature").agg(
        F.avg("change").alias("importance_mean"), F.stddev_pop("change").alias("importance_std")
    )
