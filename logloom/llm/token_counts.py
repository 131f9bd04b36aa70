"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch that were not met before lie one after another in one array of
symbols. A round looks up the rank of every adjacent pair, takes the lowest rank of each
sequence, merges all its pairs of that rank that don't overlap (leftmost first) at once and
closes the gaps. Sequences without a pair that can be merged leave the arrays; what is left
of them is their tokens.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows give
repeated rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import vocab
from logloom.llm.bpe import slices
from logloom.llm.vocab import NO_RANK, TextEncoder, Vocabulary, in_order


def merge_ragged(words: Vocabulary, sym: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pre-tokens in a row, and their numbers; they are merged together, round by round."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    rank, made = np.full(len(sym), NO_RANK), np.zeros(len(sym), dtype=np.int64)
    inner = np.flatnonzero(owner[:-1] == owner[1:])
    rank[inner], made[inner] = words.lookup(sym[inner], sym[inner + 1])
    owners, ids = [], []
    while sym.size:
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        lowest = np.minimum.reduceat(rank, starts)
        lowest = np.repeat(lowest, np.diff(np.r_[starts, len(sym)]))
        done = lowest == NO_RANK
        if done.any():
            owners.append(owner[done])
            ids.append(sym[done])
            go = ~done
            sym, owner, rank, made, lowest = sym[go], owner[go], rank[go], made[go], lowest[go]
        # in a run of overlapping hits (x x x) every second one counts, from the left
        at = np.flatnonzero(rank == lowest)
        if not at.size:
            break
        first = np.r_[True, np.diff(at) != 1]
        at = at[(at - np.maximum.accumulate(np.where(first, at, 0))) % 2 == 0]
        sym[at] = made[at]
        keep = np.ones(len(sym), dtype=bool)
        keep[at + 1] = False
        sym, owner, rank, made = sym[keep], owner[keep], rank[keep], made[keep]
        # only the pairs with a merged symbol are new
        at = at - np.arange(len(at))
        new = np.zeros(len(sym), dtype=bool)
        new[at] = new[at[at > 0] - 1] = True
        rank[new] = NO_RANK
        at = np.flatnonzero(new[:-1] & (owner[:-1] == owner[1:]))
        rank[at], made[at] = words.lookup(sym[at], sym[at + 1])
    return in_order(owners, ids, len(lengths))


def encoder(path: str) -> TextEncoder:
    """Of this Python worker."""
    return vocab.encoder(path, merge_ragged)


def token_counts(df: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``df``: ``id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                _, counts = encoder(vocabulary).encode(part.column(2), only_counts=True)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(counts)], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_column), F.lit(""))
    kind = df.schema[id_column].dataType.simpleString()
    chosen = df.select(
        F.col(id_column).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")
    )
    return chosen.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
