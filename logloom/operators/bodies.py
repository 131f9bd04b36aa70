"""Bodies of records of any length, in segments of bounded size.

A record may have ten million lines. Its lines are cut into segments by their place on a byte grid
of the file, which a scan that is made anyway gives away. A segment is gathered by itself, so what a
task holds is bounded by ``SEGMENT_BYTES`` and one line. Of a record, counts and heads are united over
all its segments; texts are joined from the first ``FIRST_SEGMENTS`` of them, which is the
whole body of any record below that size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT_BYTES = 1 << 20
FIRST_SEGMENTS = 64


def segment(bytes_before: Column, segment_bytes: int = SEGMENT_BYTES) -> Column:
    """Segment of a line from the bytes before it in its file."""
    return F.floor(bytes_before / F.lit(segment_bytes)).cast("bigint")


def segmented(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    parts: Mapping[str, Column],
    heads: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per key and ``segment``: the largest value of each head, and the lines of each part.

    A part ``p`` gives ``p``, the non-null values of its column in order, and ``n_p``, how many
    they are. ``segment_no`` counts the segments of a key from 1.
    """
    at = F.struct(*order)

    def lines(c: Column) -> Column:
        found = F.collect_list(F.when(c.isNotNull(), F.struct(at.alias("at"), c.alias("value"))))
        return F.transform(F.sort_array(found), lambda x: x["value"])

    partial = rows.groupBy(*keys, "segment").agg(
        *[F.max(c).alias(n) for n, c in (heads or {}).items()],
        *[lines(c).alias(n) for n, c in parts.items()],
        *[F.count(c).alias(f"n_{n}") for n, c in parts.items()],
    )
    return partial.withColumn("segment_no", F.row_number().over(Window.partitionBy(*keys).orderBy("segment")))


def united(
    segments: DataFrame,
    keys: Sequence[str],
    parts: Sequence[str],
    heads: Sequence[str] = (),
    first_segments: int = FIRST_SEGMENTS,
) -> DataFrame:
    """One row per key from its segments; ``cut`` tells bodies of which only the beginning is kept."""
    kept = F.col("segment_no") <= first_segments

    def joined(name: str) -> Column:
        some = kept & (F.col(f"n_{name}") > 0)
        found = F.sort_array(F.collect_list(F.when(some, F.struct("segment_no", name))))
        return F.flatten(F.transform(found, lambda x: x[name])).alias(name)

    return segments.groupBy(*keys).agg(
        *[F.max(n).alias(n) for n in heads],
        *[joined(n) for n in parts],
        *[F.sum(f"n_{n}").alias(f"n_{n}") for n in parts],
        (F.max("segment_no") > first_segments).alias("cut"),
    )
