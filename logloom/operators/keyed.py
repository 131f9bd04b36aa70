"""Bringing per-key results back to rows, and matching two sides, under skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SALTS = 1024


def _hashable(kind: T.DataType) -> bool:
    """Whether a column of this type can be hashed: no map at any depth."""
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def row_salt(df: DataFrame, buckets: int = _SALTS) -> Column:
    """A bucket number from the row's own content, so a retried task repeats it."""
    plain = [f.name for f in df.schema.fields if _hashable(f.dataType)]
    return F.pmod(F.xxhash64(*plain), F.lit(buckets)).cast("int") + 1


def count_by_key(df: DataFrame, keys: Sequence[str], *extra: Column) -> DataFrame:
    """Rows per key as ``n`` plus further aggregates; combined map-side."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *extra)


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, distinct``: different non-null values of several columns from one scan.

    Values become (column, value) pairs that are united map-side, so a task sends on each value
    once whatever the number of columns; of a long value its digest is sent.
    """

    def pair(c: str) -> Column:
        kind = dict(df.dtypes)[c]
        plain = F.col(c) + F.lit(0).cast(kind) if kind in ("double", "float") else F.col(c)  # one zero
        text = plain.cast("string")
        value = F.when(F.octet_length(text) <= 64, text).otherwise(F.sha2(text, 256))
        return F.struct(F.lit(c).alias("column"), value.alias("value"))

    pairs = df.select(F.explode(F.array(*[pair(c) for c in columns])).alias("p")).select("p.*")
    values = pairs.filter("value IS NOT NULL").distinct()
    return values.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))


def attach_by_key(
    df: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    weight: str = "n",
    hot_keys: int = 1000,
) -> DataFrame:
    """Left join of one ``stats`` row per key back to the rows of ``df``.

    ``stats[weight]`` is the number of rows a key has in ``df``. The ``hot_keys``
    heaviest keys are broadcast (never more rows than that); any other key then holds
    less than ``1 / hot_keys`` of the rows and joins by shuffle. In that shuffle the
    rows of hot keys, already served, are spread by their own hash. Null keys match.

    Build ``stats`` from the narrow input, not from an already joined ``df``: it is
    read twice here and chained joins would otherwise multiply the plan.
    """
    ranked = stats.orderBy(F.desc(weight), *keys).limit(hot_keys)
    hot = ranked.select(
        *[F.col(k).alias(f"__hk_{k}") for k in keys],
        *[F.col(v).alias(f"__hv_{v}") for v in values],
        F.lit(True).alias("__hot"),
    )
    cold = stats.select(
        *[F.col(k).alias(f"__ck_{k}") for k in keys],
        *[F.col(v).alias(f"__cv_{v}") for v in values],
        F.lit(0).alias("__csalt"),
    )
    marked = df.join(
        F.broadcast(hot), _same([(F.col(k), F.col(f"__hk_{k}")) for k in keys]), "left"
    ).withColumn("__salt", F.when(F.col("__hot"), row_salt(df)).otherwise(F.lit(0)))
    joined = marked.join(
        cold,
        _same([(F.col(k), F.col(f"__ck_{k}")) for k in keys])
        & (F.col("__salt") == F.col("__csalt")),
        "left",
    )
    found = [F.coalesce(f"__hv_{v}", f"__cv_{v}").alias(v) for v in values]
    return joined.select(*[F.col(c) for c in df.columns if c not in values], *found)


def _same(pairs) -> Column:
    cond = None
    for left, right in pairs:
        test = left.eqNullSafe(right)
        cond = test if cond is None else cond & test
    return cond


def outer_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Full outer equi-join whose null keys (which never match) are spread out.

    Column names of the two sides must differ.
    """
    lsalt = F.when(F.col(left_key).isNull(), row_salt(left)).otherwise(F.lit(0))
    rsalt = F.when(F.col(right_key).isNull(), row_salt(right)).otherwise(F.lit(0))
    a = left.withColumn("__lsalt", lsalt)
    b = right.withColumn("__rsalt", rsalt)
    cond = (a[left_key] == b[right_key]) & (a["__lsalt"] == b["__rsalt"])
    return a.join(b, cond, "full_outer").drop("__lsalt", "__rsalt")
