"""Training-order materialisation of token sequences in fixed-stride shards.

Each task encodes its documents, joins them by end tokens and cuts the stream into sequences
of one length; only its last sequence is padded. Sequences get consecutive numbers from
counts per task. A keyed Feistel network permutes the numbers; values outside the range walk
on through the network until they fall inside, so every sequence has a global slot of its own
and the order needs no sort key. Slots are cut into ranges, one file each, whose records all
have the same number of bytes: slot ``i`` of a shard starts at ``i * stride``, so a reader can
start anywhere and go on where it stopped.

A file is written by Spark's text writer: a record is the ids as little-endian 16- or 32-bit
numbers and one line feed. The path may be in any store Spark writes to; a lost executor's
files are written again by the commit protocol.

Defined results: a null or empty text is the end token alone; repeated rows are repeated in
the stream; an empty table gives no files; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.bpe import slices
from logloom.llm.token_counts import encoder
from logloom.session import stage, unstage


def feistel(x: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """A permutation of ``0 .. n - 1`` that ``key`` chooses, applied to ``x``."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % (1 << 64)) for r in range(1, rounds + 1)]

    def network(v: np.ndarray) -> np.ndarray:
        left, right = v >> shift, v & mask
        for k in keys:
            f = (right ^ k) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        return left << shift | right

    out = network(x.astype(np.uint64))
    while (outside := np.flatnonzero(out >= np.uint64(n))).size:
        out[outside] = network(out[outside])
    return out.astype(np.int64)


class _Stream:
    """Documents joined to sequences: what is left over waits for the next documents."""

    def __init__(self, length: int, end_id: int, ids: pa.Array):
        self.length, self.end_id = length, end_id
        self.tokens, self.at, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), ids

    def add(self, flat: np.ndarray, counts: np.ndarray, ids: pa.Array) -> None:
        size = counts + 1
        first = np.cumsum(size) - size
        new = np.full(int(size.sum()), self.end_id, dtype=np.int64)
        new[np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(len(flat))] = flat
        self.at = np.concatenate([self.at, first + len(self.tokens)])
        self.tokens = np.concatenate([self.tokens, new])
        self.ids = pa.concat_arrays([self.ids, ids])

    def take(self, last: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First document of each sequence, its tokens before, documents, tokens and the padded sequences."""
        n = -(-len(self.tokens) // self.length) if last else len(self.tokens) // self.length
        start = np.arange(n) * self.length
        stop = np.minimum(start + self.length, len(self.tokens))
        of = np.searchsorted(self.at, start, "right") - 1
        documents = np.searchsorted(self.at, stop, "left") - of
        padded = np.full(n * self.length, self.end_id, dtype=np.int64)
        used = min(n * self.length, len(self.tokens))
        padded[:used] = self.tokens[:used]
        out = self.ids.take(pa.array(of)), start - self.at[of], documents, stop - start, padded.reshape(n, self.length)
        rest = np.searchsorted(self.at, used, "right") - 1 if used < len(self.tokens) else len(self.at)
        self.tokens, self.at, self.ids = self.tokens[used:], self.at[rest:] - used, self.ids.slice(rest)
        return out


def sequences(
    df: DataFrame,
    vocabulary: str,
    length: int = 1024,
    end_id: int = 50256,
    id_column: str = "doc_id",
    text_column: str = "text",
    wide: bool = False,
) -> DataFrame:
    """``task, number, id, start, n_docs, n_tokens, packed``: sequences, numbered within each task.

    A sequence begins in document ``id``, ``start`` of whose tokens stand before it. ``packed``
    is the compressed record, ids as 16-bit numbers or, if ``wide``, 32-bit ones.
    """
    kind = "<u4" if wide else "<u2"
    names = ["task", "number", "id", "start", "n_docs", "n_tokens", "packed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, stream = TaskContext.get().partitionId(), 0, None
        pack = zstandard.ZstdCompressor(level=3).compress

        def rows(last: bool = False) -> Iterator[pa.RecordBatch]:
            nonlocal number
            ids, start, documents, tokens, padded = stream.take(last)
            if not (n := len(start)):
                return
            packed = [pack(r.tobytes()) for r in padded.astype(kind)]
            columns = [np.full(n, task, np.int32), np.arange(number, number + n), start, documents, tokens]
            number += n
            made = [pa.array(c, pa.int64()) for c in columns[1:]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0]), made[0], ids, *made[1:], pa.array(packed, pa.binary())], names
            )

        for batch in batches:
            for part in slices(batch):
                if stream is None:
                    stream = _Stream(length, end_id, part.column(0).slice(0, 0))
                stream.add(*encoder(vocabulary).encode(part.column(1)), part.column(0))
                yield from rows()
        if stream is not None:
            yield from rows(last=True)

    id_kind = df.schema[id_column].dataType.simpleString()
    return df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(
        run, f"task int, number long, id {id_kind}, start long, n_docs long, n_tokens long, packed binary"
    )


def write_shards(
    cut: DataFrame, path: str, length: int = 1024, wide: bool = False, shard_bytes: int = 16 << 20, key: int = 20
) -> DataFrame:
    """Write the sequences of ``cut`` under ``path`` in training order.

    Returns ``slot, shard, id, start, n_docs, n_tokens`` of every sequence. Shard ``k`` is the one file
    in ``shard=k``; ``shard_bytes`` bounds it.
    """
    stride = length * (4 if wide else 2) + 1
    per_shard = max(1, shard_bytes // stride)
    staged = stage(cut)
    tasks = staged.groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each task
    sizes = np.zeros(max((r["task"] for r in tasks), default=-1) + 1, dtype=np.int64)
    for r in tasks:
        sizes[r["task"]] = r["n"]
    n = int(sizes.sum())
    starts = staged.sparkSession.sparkContext.broadcast(np.cumsum(sizes) - sizes)
    names = ["id", "start", "n_docs", "n_tokens", "packed"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = starts.value[batch.column(0).to_numpy()] + batch.column(1).to_numpy()
            slot = feistel(number, n, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot), *batch.columns[2:]], ["slot", *names])

    kinds = dict(staged.dtypes)
    shape = "slot long, " + ", ".join(f"{c} {kinds[c]}" for c in names)
    numbered = staged.select("task", "number", *names)
    placed = numbered.mapInArrow(place, shape).withColumn("shard", F.floor(F.col("slot") / per_shard).cast("int"))
    shards = max(1, -(-n // per_shard))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacked = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            raw = [unpacked(z) for z in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(raw, pa.binary())], ["shard", "slot", "value"])

    dealt = placed.repartitionById(shards, F.col("shard")).select("shard", "slot", "packed")  # a range of slots a task
    records = dealt.mapInArrow(unpack, "shard int, slot long, value binary")
    # The sort comes last: behind a Python step the writer would sort by shard once more and, on spills, lose the slots' order.
    ordered = records.sortWithinPartitions("shard", "slot")
    records = ordered.select("shard", F.col("value").cast("string").alias("value"))
    records.write.partitionBy("shard").text(path)
    index = stage(placed.select("slot", "shard", "id", "start", "n_docs", "n_tokens"))
    unstage(staged)
    return index


def read_records(
    spark: SparkSession, path: str, length: int = 1024, wide: bool = False, shard_bytes: int = 16 << 20, start: int = 0
) -> DataFrame:
    """``slot, record`` (the bytes of the ids) from slot ``start`` on; earlier shards are not opened."""
    stride = length * (4 if wide else 2) + 1
    per_shard = max(1, shard_bytes // stride)
    files = spark.read.format("binaryFile").load(path)
    files = files.filter(F.col("shard") >= start // per_shard).select("shard", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data, first = memoryview(content.as_buffer()), shard * per_shard
                n = len(data) // stride
                for at in range(max(0, start - first), n, 1024):
                    here = range(at, min(at + 1024, n))
                    records = [bytes(data[i * stride : (i + 1) * stride - 1]) for i in here]
                    slots = pa.array([first + i for i in here], pa.int64())
                    yield pa.RecordBatch.from_arrays([slots, pa.array(records, pa.binary())], ["slot", "record"])

    return files.mapInArrow(run, "slot long, record binary")


def record_ids(records: DataFrame, wide: bool = False) -> DataFrame:
    """``slot, ids`` of ``records``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            ids = np.frombuffer(b"".join(raw), dtype="<u4" if wide else "<u2").astype(np.int32)
            ends = np.cumsum([0, *(len(r) // (4 if wide else 2) for r in raw)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(ids))], ["slot", "ids"])

    return records.select("slot", "record").mapInArrow(run, "slot long, ids array<int>")
