"""Best-fit packing of tokenised documents with a swap-based local search.

A document longer than a sequence is cut into whole sequences and a first piece with the
rest. Whole pieces are sequences already. The others are dealt into blocks of bounded size
at random; a block is packed best fit, longest first, and then improved: a bin that is not
full takes a piece from an emptier one, or exchanges one for one, two for one or one for
two, whenever that raises the sum of squared fills, until nothing does. Pieces of bins that
are still not full meet again in new blocks, until one block holds them all, their free room
is less than a sequence or a round gains none of it.

Defined results: a null or empty text is the end token alone; repeated rows are packed each;
an empty table gives no rows; other columns are not read, so their names don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.bpe import slices
from logloom.llm.token_counts import encoder
from logloom.session import stage


def pieces(
    df: DataFrame,
    vocabulary: str,
    size: int = 1024,
    end_id: int = 2,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``id, piece, start, length, ids_crc32``: every document's ids and ``end_id``, cut at ``size``."""
    tail = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows: list[list] = [[], [], [], [], []]
                flat, counts = encoder(vocabulary).encode(part.column(1))
                data, stops = flat.tobytes(), np.cumsum(counts * 4)
                for i, (n, stop) in enumerate(zip((counts + 1).tolist(), stops.tolist())):
                    ids = data[stop - 4 * (n - 1) : stop] + tail
                    ends = range(n % size or min(n, size), n + 1, size)
                    start = 0
                    for k, end in enumerate(ends):
                        crc = zlib.crc32(ids[4 * start : 4 * end])
                        for column, value in zip(rows, (i, k, start, end - start, crc)):
                            column.append(value)
                        start = end
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(rows[0], pa.int64())),
                        pa.array(rows[1], pa.int32()),
                        *(pa.array(c, pa.int64()) for c in rows[2:]),
                    ],
                    ["id", "piece", "start", "length", "ids_crc32"],
                )

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(
        run, f"id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(lengths: Sequence[int], size: int) -> list[list[int]]:
    """Bins of item numbers; items must come longest first."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(size + 1)]
    open_rooms = 0  # bit r: some bin has room r
    for item, length in enumerate(lengths):
        fitting = open_rooms >> length
        if fitting:
            left = length + (fitting & -fitting).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                open_rooms &= ~(1 << left)
            left -= length
        else:
            b, left = len(bins), size - length
            bins.append([])
        bins[b].append(item)
        if left:
            room[left].append(b)
            open_rooms |= 1 << left
    return bins


class LocalSearch:
    """Moves and exchanges between bins that are not full; each raises the sum of squared fills."""

    def __init__(self, bins: list[list[int]], lengths: Sequence[int], size: int):
        self.bins, self.lengths, self.size = bins, lengths, size
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.holders: dict[int, dict[int, tuple[int, ...]]] = {}
        self.sums: dict[int, dict[int, tuple[int, ...]]] = {}
        self.offered = 0  # bit t: some bin that is not full can give items of t tokens
        for b, f in enumerate(self.fill):
            if f < size:
                self._add(b)

    def _offers(self, b: int) -> dict[int, tuple[int, ...]]:
        """Tokens -> the one or two items of bin ``b`` with so many."""
        of_length: dict[int, list[int]] = {}
        for i in self.bins[b]:
            of_length.setdefault(self.lengths[i], []).append(i)
        out = {}
        kinds = list(of_length)
        for x, one in enumerate(kinds):
            if len(of_length[one]) > 1:
                out[2 * one] = tuple(of_length[one][:2])
            for two in kinds[:x]:
                out[one + two] = (of_length[one][0], of_length[two][0])
        return out | {n: (items[0],) for n, items in of_length.items()}

    def _add(self, b: int) -> None:
        offers = self.sums[b] = self._offers(b)
        for n in offers:
            self.holders.setdefault(n, {})[b] = ()
            self.offered |= 1 << n

    def _drop(self, b: int) -> None:
        for n in self.sums.pop(b):
            of = self.holders[n]
            del of[b]
            if not of:
                del self.holders[n]
                self.offered &= ~(1 << n)

    def _better(self, a: int) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
        """The exchange that fills bin ``a`` most: other bin, what ``a`` gives, what it takes."""
        gap, best = self.size - self.fill[a], None
        gives = {0: ()} | self.sums[a]
        most = 0
        for given, items in gives.items():
            wanted = self.offered >> given & (1 << gap + 1) - 1
            while wanted and (d := wanted.bit_length() - 1) > most:
                for b in self.holders[given + d]:
                    take = self.sums[b].get(given + d, ())
                    if b != a and d > self.fill[b] - self.fill[a] and len(items) + len(take) <= 3:
                        best, most = (b, items, take), d
                        break
                wanted &= ~(1 << d)
            if most == gap:
                break
        return best

    def run(self) -> list[list[int]]:
        """The bins that are left."""
        again = True
        while again:
            again = False
            for a in sorted(self.sums, key=lambda b: (-self.fill[b], b)):
                while a in self.sums and (found := self._better(a)):
                    b, give, take = found
                    again = True
                    self._drop(a)
                    self._drop(b)
                    self.bins[a] = [i for i in self.bins[a] if i not in give] + list(take)
                    self.bins[b] = [i for i in self.bins[b] if i not in take] + list(give)
                    for x in (a, b):
                        self.fill[x] = sum(self.lengths[i] for i in self.bins[x])
                        if 0 < self.fill[x] < self.size:
                            self._add(x)
        return [b for b in self.bins if b]


def pack_items(lengths: Sequence[int], size: int) -> list[list[int]]:
    """Bins of item numbers for items in any order."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    longest_first = [lengths[i] for i in order]
    bins = LocalSearch(best_fit(longest_first, size), longest_first, size).run()
    return [[order[i] for i in b] for b in bins]


def _block_packer(size: int, first: int):
    """Packs one block; its sequences are numbered behind those of block ``first``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "__row"], ascending=[False, True]).reset_index(drop=True)
        lengths, block = pdf["length"].tolist(), int(pdf["__block"].iloc[0])
        ids, offsets, fills = [0] * len(pdf), [0] * len(pdf), [0] * len(pdf)
        for k, items in enumerate(pack_items(lengths, size)):
            end = 0
            for i in items:
                ids[i], offsets[i] = (first + block) << 32 | k, end
                end += lengths[i]
            for i in items:
                fills[i] = end
        return pdf.drop(columns="__block").assign(sequence_id=ids, offset=offsets, __fill=fills)

    return run


def pack(cut: DataFrame, size: int = 1024, block_rows: int = 4096) -> DataFrame:
    """``cut`` (with ``length``) and ``sequence_id``, ``offset`` of each row.

    ``block_rows`` is how many pieces a block holds on average; it bounds what a task packs at
    once. ``cut`` is staged in the shared folder and the result is read from there.
    """
    staged = stage(cut.withColumn("__row", F.monotonically_increasing_id()))
    whole = staged.filter(F.col("length") >= size)
    whole = whole.withColumn("sequence_id", -1 - F.col("__row")).withColumn("offset", F.lit(0).cast("long"))
    results, rest = [whole], staged.filter(F.col("length") < size)
    shape = ", ".join(f"`{n}` {t}" for n, t in staged.dtypes) + ", sequence_id long, offset long, __fill long"
    at, saved = 0, None
    while True:
        blocks = max(1, -(-rest.count() // block_rows))
        deal = F.pmod(F.xxhash64("__row", F.lit(at)), F.lit(blocks)).cast("long")
        packed = stage(rest.withColumn("__block", deal).groupBy("__block").applyInPandas(_block_packer(size, at), shape))
        at += blocks
        bins = packed.filter(F.col("__fill") < size).groupBy("sequence_id").agg(F.first("__fill").alias("fill"))
        free = bins.agg(F.coalesce(F.sum(size - F.col("fill")), F.lit(0))).first()[0]
        # another round can save the free room of all open bins at most
        if blocks == 1 or free < size or saved is not None and free >= saved:
            results.append(packed.drop("__fill"))
            break
        saved = free
        results.append(packed.filter(F.col("__fill") >= size).drop("__fill"))
        rest = packed.filter(F.col("__fill") < size).drop("sequence_id", "offset", "__fill")
    out = results[0]
    for part in results[1:]:
        out = out.unionByName(part)
    return out.drop("__row")
