"""BPE encoding and decoding with segment trees over adjacent pair ranks.

Every pre-token is a row of symbols. The leaves of its segment tree hold the rank of the
pair that starts there together with its place, inner nodes the smaller of their two
children, so the root is the leftmost pair of lowest rank. A merge changes three leaves
(the pair itself, the pair before it, the leaf of the symbol that went), each in a
logarithmic number of steps, until the root shows that nothing can be merged.

Short pre-tokens are merged as rows of numpy matrices, one tree a row, equal sizes
together; a long one has a tree of its own.

Defined results: a null text is empty; an empty text has no tokens and decodes to an empty
text; repeated rows give repeated rows; only the named columns are read, so other columns
and their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.vocab import NO_RANK, Vocabulary, encoder, in_order, load

LONG = 64  # symbols from which a pre-token gets a tree of its own
_NONE = np.int64(2**62)


def merge_rows(vocab: Vocabulary, flat: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge pre-tokens of at most ``width`` (a power of two) symbols, one tree a row; ids and their numbers."""
    n = len(lengths)
    sym = np.zeros((n, width), dtype=np.int64)
    inside = np.arange(width) < lengths[:, None]
    sym[inside] = flat
    after = np.where(np.arange(1, width + 1) < lengths[:, None], np.arange(1, width + 1), -1)
    before = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()
    tree = np.full((n, 2 * width), _NONE, dtype=np.int64)
    ranks, _ = vocab.lookup(sym[:, :-1], sym[:, 1:]) if width > 1 else (np.empty((n, 0), np.int64), None)
    pair = np.where(inside[:, 1:] & (ranks != NO_RANK), ranks << 8 | np.arange(width - 1), _NONE)
    tree[:, width : 2 * width - 1] = pair
    for i in range(width - 1, 0, -1):
        np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])

    def update(rows: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
        at = place + width
        tree[rows, at] = value
        while at.size and at[0] > 1:
            at = at >> 1
            tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

    def key(rows: np.ndarray, place: np.ndarray, right: np.ndarray) -> np.ndarray:
        rank, _ = vocab.lookup(sym[rows, place], sym[rows, right])
        return np.where(rank != NO_RANK, rank << 8 | place, _NONE)

    rows = np.flatnonzero(tree[:, 1] < _NONE) if width > 1 else np.empty(0, np.int64)
    while rows.size:
        i = tree[rows, 1] & 255
        j = after[rows, i]
        _, made = vocab.lookup(sym[rows, i], sym[rows, j])
        sym[rows, i] = made
        sym[rows, j] = -1
        k = after[rows, j]
        after[rows, i] = k
        has = k >= 0
        before[rows[has], k[has]] = i[has]
        update(rows, j, np.full(len(rows), _NONE))
        value = np.full(len(rows), _NONE)
        value[has] = key(rows[has], i[has], k[has])
        update(rows, i, value)
        h = before[rows, i]
        has = h >= 0
        update(rows[has], h[has], key(rows[has], h[has], i[has]))
        rows = rows[tree[rows, 1] < _NONE]
    left = inside & (sym >= 0)
    return sym[left], left.sum(axis=1)


def merge_long(vocab: Vocabulary, symbols: np.ndarray) -> np.ndarray:
    """Merge one pre-token of any length with a segment tree of its own."""
    sym, n, pairs = symbols.tolist(), len(symbols), vocab.pairs
    size = 1 << max(n - 1, 1).bit_length()
    shift = size.bit_length()
    tree = [_none := 1 << 62] * (2 * size)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]

    def key(i: int, j: int) -> int:
        found = pairs.get((sym[i], sym[j]))
        return found[0] << shift | i if found else _none

    def update(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

    for i in range(n - 1):
        tree[size + i] = key(i, i + 1)
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    while tree[1] < _none:
        i = tree[1] & (1 << shift) - 1
        j = after[i]
        sym[i], sym[j] = pairs[sym[i], sym[j]][1], -1
        k = after[i] = after[j]
        update(j, _none)
        update(i, key(i, k) if k >= 0 else _none)
        if k >= 0:
            before[k] = i
        if (h := before[i]) >= 0:
            update(h, key(h, i))
    return np.array([s for s in sym if s >= 0], dtype=np.int64)


def merge_trees(vocab: Vocabulary, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pre-tokens in a row, and their numbers."""
    starts = np.cumsum(lengths) - lengths
    width = np.ones(len(lengths), dtype=np.int64)
    while (short := width < np.minimum(lengths, 2 * LONG)).any():
        width[short] *= 2
    owners, ids = [], []
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        if w > LONG:
            for i in at.tolist():
                merged = merge_long(vocab, flat[starts[i] : starts[i] + lengths[i]])
                owners.append(np.full(len(merged), i))
                ids.append(merged)
        else:
            mine = np.repeat(width == w, lengths)
            merged, counts = merge_rows(vocab, flat[mine], lengths[at], w)
            owners.append(np.repeat(at, counts))
            ids.append(merged)
    return in_order(owners, ids, len(lengths))


def encode_all(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit ids of all texts in a row, and their number for each text."""
    return encoder(path, merge_trees).encode(texts)


def encode(df: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``df``: ``id`` and the token ``ids`` of its whole text.

    ``vocabulary`` is a path every executor can open. Special strings inside a text become
    their own ids; none are added.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, counts = encode_all(vocabulary, part.column(1))
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["id", "ids"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(
        run, f"id {kind}, ids array<int>"
    )


def decode(df: DataFrame, vocabulary: str, keep: Sequence[str] = ("id",), ids_column: str = "ids") -> DataFrame:
    """Adds ``decoded``: the tokens of each id list joined by blanks, special tokens included.

    The vocabulary has no decoder, so that is its decoding. A null list decodes as an empty
    one; an id the vocabulary lacks is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = load(vocabulary)
        table = [vocab.tokens.get(i) for i in range(max(vocab.tokens) + 1)]
        whole = None not in table
        for batch in batches:
            for part in slices(batch):
                lists = part.column(part.num_columns - 1)
                flat, ends = lists.flatten().to_pylist(), np.cumsum([len(x) if x.is_valid else 0 for x in lists])
                texts, at = [], 0
                for end in ends.tolist():
                    if whole:
                        texts.append(" ".join(map(table.__getitem__, flat[at:end])))
                    else:
                        named = (table[i] if 0 <= i < len(table) else None for i in flat[at:end])
                        texts.append(" ".join(t for t in named if t is not None))
                    at = end
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    names = [*keep, ids_column]
    chosen = df.select(*names)
    kinds = ", ".join(f"`{n}` {t}" for n, t in chosen.dtypes)
    return chosen.mapInArrow(run, f"{kinds}, decoded string")


def slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes, so that a task holds little at a time."""
    rows = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
