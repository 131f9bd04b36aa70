"""Shards that all hold the mixture of the whole: proportional stratified interleaving.

Rows of a source are put into a seeded random order. A row's place is its rank plus a fixed
phase of its source, divided by the rows of the source, so every source is spread evenly over
the places from 0 to 1. Sorted by place and cut into equal runs, each shard holds every
source in proportion, but for rounding. The law is ``rows``: counts of shards differ by one at
most.

Ranks and positions come from counts: keys that are uniform by construction are cut into
cells of bounded size, cells are numbered by running sums over the small table of their
counts, and rows only within their cell. No source and no shard is ever sorted in one task.

Defined results: a null source is a source; null texts have no bytes; null ids and rows that
are equal in all that orders them are told apart by nothing and can change places with
each other only; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.session import stage, unstage


def _unit(key: Column) -> Column:
    """A number from 0 to 1 out of a 64-bit hash."""
    return F.shiftrightunsigned(key, 11) / F.lit(float(1 << 53))


def _numbered(rows: DataFrame, group: list[str], of: Column, order: list[str], name: str, cell_rows: int) -> DataFrame:
    """``rows`` with ``name``: the number of the row in its group of ``of`` rows by ``at`` (0 to 1), then ``order``."""
    cells = F.ceil(of / cell_rows)
    celled = rows.withColumn("__cell", F.least(F.floor(F.col("at") * cells), cells - 1).cast("long"))
    counts = celled.groupBy(*group, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    starts = _starts(counts, group)
    inside = Window.partitionBy(*group, "__cell").orderBy("at", *order)
    ranked = celled.withColumn("__rank", F.row_number().over(inside) - 1)
    return (
        _attach(ranked, starts, [*group, "__cell"], "__start")
        .withColumn(name, F.col("__start") + F.col("__rank"))
        .drop("__start", "__rank", "__cell")
    )


def _starts(counts: DataFrame, group: list[str], fan: int = 1000) -> DataFrame:
    """Rows in the cells before each cell of its group, in two steps: over ranges of ``fan`` cells, then inside each range."""
    ranged = counts.withColumn("__range", F.floor(F.col("__cell") / fan).cast("long"))
    earlier = lambda window: F.coalesce(F.sum("__n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = ranged.groupBy(*group, "__range").agg(F.sum("__n").alias("__n"))
    sums = sums.withColumn("__before", earlier(Window.partitionBy(*group).orderBy("__range"))).drop("__n")
    inside = earlier(Window.partitionBy(*group, "__range").orderBy("__cell"))
    both = _attach(ranged.withColumn("__inside", inside), sums, [*group, "__range"], "__before")
    return both.select(*group, "__cell", (F.col("__before") + F.col("__inside")).alias("__start"))


def _attach(rows: DataFrame, values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One value per key to rows, null keys included; hot keys of the join are split at run time."""
    named = values.select(*[F.col(k).alias(f"__k_{k}") for k in keys], value)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return rows.join(named, same).drop(*[f"__k_{k}" for k in keys])


def interleaved(
    df: DataFrame,
    shards: int = 24,
    seed: int = 17,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    cell_rows: int = 1000,
) -> DataFrame:
    """``id, source, size, text_crc32, shard, slot`` of every row of ``df``.

    ``size`` is the UTF-8 bytes of the text plus 8. ``slot`` counts from 0 in each shard.
    ``cell_rows`` is how many rows one cell holds on average.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = df.select(
        F.col(id_column).alias("id"),
        F.col(source_column).alias("source"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col(id_column), text).alias("key"),
    )
    rows = stage(rows.withColumn("at", _unit(F.col("key"))))
    order = ["key", "id", "size"]
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("of"))
    ranked = _numbered(_attach(rows, sizes, ["source"], "of"), ["source"], F.col("of"), order, "rank", cell_rows)
    phase = _unit(F.xxhash64(F.lit(seed), F.lit("phase"), F.col("source")))
    placed = stage(ranked.withColumn("at", (F.col("rank") + phase) / F.col("of")).drop("of", "rank"))
    total = placed.count()
    numbered = _numbered(placed, [], F.lit(total), ["source", *order], "position", cell_rows)
    shard = F.expr(f"position * {shards}L div {max(total, 1)}L")
    out = numbered.withColumn("shard", shard.cast("int"))
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    out = out.select("id", "source", "size", "text_crc32", "shard", (F.col("position") - first).alias("slot"))
    result = stage(out)
    unstage(rows, placed)
    return result
