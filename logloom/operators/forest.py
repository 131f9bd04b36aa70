"""Isolation forest (Liu, Ting, Zhou, ICDM 2008) on Spark.

Trees see only small subsamples, so training is one bounded group per tree; scoring is
a narrow pass over the rows with the trees broadcast (at most ``trees * 2 * sample``
nodes, whatever the data).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.operators.quantiles import quantile_row
from logloom.session import durable

_NODES = "tree int, node int, feature int, cut double, low int, high int, depth double"


@dataclass(frozen=True)
class Forest:
    """Node arrays, one row per tree."""

    feature: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    depth: np.ndarray
    sample: int


def mean_depth(n: int) -> float:
    """Average path length of an unsuccessful search among ``n`` points."""
    if n < 2:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def fit_forest(
    df: DataFrame, key: str, features: str, trees: int = 100, sample: int = 256, seed: int = 7
) -> Forest:
    """Train on ``features``, an array<double> column.

    Each row joins a tree when its own hash for that tree is small enough, so about
    ``1.5 * sample`` rows reach a tree and the smallest hashes make its subsample.
    """
    total = df.count()
    share = min(1.0, 1.5 * (sample + 40) / max(total, 1))
    limit = int(share * 2**31)

    def draw(tree):
        return F.pmod(F.xxhash64(F.col(key), F.lit(seed), tree), F.lit(2**31))

    drawn = (
        df.select(key, F.col(features).cast("array<double>").alias("x"))
        .withColumn(
            "tree",
            F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < limit)),
        )
        .withColumn("rank", draw(F.col("tree")))
    )
    ceiling = math.ceil(math.log2(max(sample, 2)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["rank", key], kind="stable").head(sample)
        tree = int(rows["tree"].iloc[0])
        x = np.vstack(rows["x"].to_numpy())
        rng = np.random.default_rng([seed, tree])
        out: list[tuple] = []
        todo = [(0, np.arange(len(x)), 0)]
        made = 1
        while todo:
            node, part, depth = todo.pop()
            values = x[part]
            open_features = np.flatnonzero(values.max(axis=0) > values.min(axis=0))
            if depth >= ceiling or len(part) < 2 or not len(open_features):
                out.append((tree, node, -1, 0.0, -1, -1, depth + mean_depth(len(part))))
                continue
            f = int(rng.choice(open_features))
            cut = float(rng.uniform(values[:, f].min(), values[:, f].max()))
            below = values[:, f] <= cut
            low, high, made = made, made + 1, made + 2
            out.append((tree, node, f, cut, low, high, 0.0))
            todo += [(low, part[below], depth + 1), (high, part[~below], depth + 1)]
        return pd.DataFrame(out, columns=["tree", "node", "feature", "cut", "low", "high", "depth"])

    nodes = drawn.groupBy("tree").applyInPandas(grow, _NODES).toPandas()
    return _pack(nodes, trees, min(sample, total))


def _pack(nodes: pd.DataFrame, trees: int, sample: int) -> Forest:
    grown = sorted(nodes["tree"].unique())
    width = int(nodes["node"].max()) + 1
    row = nodes["tree"].map({t: i for i, t in enumerate(grown)}).to_numpy()
    at = nodes["node"].to_numpy()

    def table(name: str, fill, kind) -> np.ndarray:
        out = np.full((len(grown), width), fill, dtype=kind)
        out[row, at] = nodes[name].to_numpy()
        return out

    return Forest(
        table("feature", -1, np.int32), table("cut", 0.0, np.float64), table("low", -1, np.int32),
        table("high", -1, np.int32), table("depth", 0.0, np.float64), sample,
    )


def score_forest(df: DataFrame, forest: Forest, features: str, out: str = "iso_score") -> DataFrame:
    """Add the score ``2^(-mean path / c)``: near 1 is isolated, near 0.5 is ordinary."""
    shared = df.sparkSession.sparkContext.broadcast(forest)
    norm = mean_depth(forest.sample) or 1.0
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = shared.value
        for pdf in batches:
            x = np.vstack(pdf[features].to_numpy()).astype(np.float64) if len(pdf) else np.empty((0, 1))
            total = np.zeros(len(pdf))
            rows = np.arange(len(pdf))
            for t in range(f.feature.shape[0]):
                node = np.zeros(len(pdf), dtype=np.int32)
                while True:
                    feature = f.feature[t, node]
                    inner = feature >= 0
                    if not inner.any():
                        break
                    value = x[rows, np.where(inner, feature, 0)]
                    step = np.where(value <= f.cut[t, node], f.low[t, node], f.high[t, node])
                    node = np.where(inner, step, node)
                total += f.depth[t, node]
            yield pdf.assign(**{out: np.power(2.0, -total / f.feature.shape[0] / norm)})

    return df.mapInPandas(score, schema)


def flag_top_share(scored: DataFrame, score: str, contamination: float = 0.1) -> DataFrame:
    """Label the top share of scores: ``anomaly_score`` is the score less the cut, flagged when positive."""
    cut = quantile_row(scored, score, {"q": 1.0 - contamination}).scalar()
    margin = F.col(score) - cut
    return scored.withColumn("anomaly_score", margin).withColumns(
        {
            "is_anomaly": F.col("anomaly_score") > 0,
            "anomaly_label": F.when(F.col("anomaly_score") > 0, -1).otherwise(1),
        }
    )


def isolation_forest(
    df: DataFrame, key: str, features: Sequence[str] | str, contamination: float = 0.1, **options
) -> DataFrame:
    """Fit, score and label in one go; ``features`` are columns or one array column."""
    if isinstance(features, str):
        rows = df.withColumn("__x", F.col(features).cast("array<double>"))
    else:
        rows = df.withColumn("__x", F.array(*[F.col(c).cast("double") for c in features]))
    forest = fit_forest(rows, key, "__x", **options)
    # scored once, then read for the cut and for the labels
    scored = durable(score_forest(rows, forest, "__x"))
    return flag_top_share(scored, "iso_score", contamination).drop("__x")


def flagged_by(labelled: DataFrame, *by: str) -> DataFrame:
    """Flagged rows per group."""
    return labelled.filter("is_anomaly").groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
