"""Running state over ordered rows, without one task per key.

A plain window with ``PARTITION BY key`` sends every row of a key to one task. A
log file, a session or a user may hold a third of all rows, so the operators here
cut each key into *chunks* (a file split, a time bucket, a block of line numbers):

1. each chunk is reduced to one row of state (a map-side combined aggregate);
2. the state is carried from chunk to chunk over that small table, itself chunked
   again when several chunk levels are given;
3. the carried state enters the chunk as one seed row, and an ordinary window over
   ``(key, chunk)`` does the rest.

Only step 3 shuffles the rows, and only once, by ``(key, chunk)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PHASE = "__phase"


def scan_prior(
    df: DataFrame,
    keys: Sequence[str],
    chunks: Sequence[str],
    order: Sequence[Column | str],
    last: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add state over all rows of the same key that come strictly before a row.

    ``last``   output name -> expression; its latest non-null value before the row.
    ``totals`` output name -> expression; its sum before the row (0 when none).
    ``chunks`` names of columns, coarse to fine, that follow the order of the rows.
    ``order``  total order inside a chunk. Nulls sort first: give a null flag ahead
    of a column whose nulls must sort last.
    """
    last, totals = dict(last or {}), dict(totals or {})
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    value = {name: f"__v_{name}" for name in (*last, *totals)}
    rows = df.withColumns(
        {
            _PHASE: F.lit(1),
            **{value[n]: e for n, e in last.items()},
            **{value[n]: e for n, e in totals.items()},
        }
    )
    if chunks:
        carried = _carry(df, keys, chunks, order, last, totals)
        seeds = carried.select(
            *keys, *chunks, F.lit(0).alias(_PHASE), *[F.col(n).alias(v) for n, v in value.items()]
        )
        rows = rows.unionByName(seeds, allowMissingColumns=True)
    before = (
        Window.partitionBy(*keys, *chunks)
        .orderBy(_PHASE, *order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    out = rows.withColumns(
        {
            **{n: F.last(value[n], ignorenulls=True).over(before) for n in last},
            **{n: F.coalesce(F.sum(value[n]).over(before), F.lit(0)) for n in totals},
        }
    )
    return out.filter(F.col(_PHASE) == 1).drop(_PHASE, *value.values())


def scan_some(df: DataFrame, needs_state: Column, *args, **kwargs) -> DataFrame:
    """``scan_prior`` over the rows with ``needs_state``; the others pass by it with null state.

    Rows without a key or a place in the order would otherwise all meet in one chunk.
    """
    needs = F.coalesce(needs_state, F.lit(False))
    scanned = scan_prior(df.filter(needs), *args, **kwargs)
    added = {f.name: F.lit(None).cast(f.dataType) for f in scanned.schema.fields if f.name not in df.columns}
    return scanned.unionByName(df.filter(~needs).withColumns(added))


def _carry(df, keys, chunks, order, last, totals) -> DataFrame:
    """One row per chunk with the state at its start."""
    position = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    reduced = (
        df.select(
            *keys,
            *chunks,
            position.alias("__at"),
            *[e.alias(n) for n, e in last.items()],
            *[e.alias(n) for n, e in totals.items()],
        )
        .groupBy(*keys, *chunks)
        .agg(
            *[
                F.max_by(n, F.when(F.col(n).isNotNull(), F.col("__at"))).alias(f"__end_{n}")
                for n in last
            ],
            *[F.sum(n).alias(f"__end_{n}") for n in totals],
            F.count(F.lit(1)).alias("__rows"),
        )
        .drop("__rows")
    )
    return scan_prior(
        reduced,
        keys,
        list(chunks)[:-1],
        [chunks[-1]],
        last={n: F.col(f"__end_{n}") for n in last},
        totals={n: F.col(f"__end_{n}") for n in totals},
    )


def time_chunk(ts: Column, width: str = "1 hour") -> Column:
    """Chunk number of a timestamp; rows without a time form the last chunk."""
    seconds = {
        "1 minute": 60,
        "10 minutes": 600,
        "1 hour": 3600,
        "1 day": 86400,
    }[width]
    bucket = F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000))
    return F.coalesce(bucket.cast("bigint"), F.lit(2**62))


def line_chunk(line_no: Column, lines: int = 1_000_000) -> Column:
    """Chunk number of a line number."""
    return F.floor(line_no / F.lit(lines)).cast("bigint")
