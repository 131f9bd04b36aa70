"""Quality rules: counts of each text, fixed rules, and an isolation forest over rule statistics.

The forest is fitted on ratios of a bounded sample of rows that the fixed rules pass
(labelled good ones where there are labels). Its trees split a random ratio at a random
value of the corpus; a document that few splits set apart has short paths and a high score.
The score from which a document is rejected is calibrated on all labelled rows.

Defined results: a null or empty text has zero counts and fails (fewer than ``least_words``
words); repeated rows give repeated rows; ids may be null; other columns are not read. Without
labels of both kinds the threshold is ``default_threshold``. An empty table gives no rows.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.bpe import slices
from logloom.llm.ngram_join import row_key
from logloom.llm.vocab import release
from logloom.session import stage, unstage

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE_COUNTS = ("n_lines", "n_letters", "n_upper", "n_marks", "n_stutters")
_WINDOW = 5
# The limits of the fixed rules.
LEAST_WORDS, MOST_REPEATED = 10, 20
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_PLAIN = bytes([*range(48, 58), *_LETTERS, *range(9, 14), 32, *range(128, 256)])


def repeated_words(words: list[bytes], window: int = _WINDOW) -> int:
    """Words inside windows of ``window`` words that the text holds twice or more."""
    if len(words) <= window:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    m = len(h) - window + 1
    key = h[:m].copy()
    for j in range(1, window):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[j : m + j]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not twice.size:
        return 0
    found = np.flatnonzero(np.isin(key, twice))
    covered = np.zeros(len(h), dtype=bool)
    for j in range(window):
        covered[found + j] = True
    return int(covered.sum())


def rule_counts(text: str | None) -> tuple[int, ...]:
    """``COUNTS`` and ``MORE_COUNTS`` of one text."""
    if not text:
        return (0,) * (len(COUNTS) + len(MORE_COUNTS))
    data = text.encode("utf-8")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    word_bytes = sum(map(len, words))
    return (
        len(words),
        len(text) - (len(data) - word_bytes),
        sum(map(data.count, (bytes([c]) for c in _SYMBOLS))),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(data) - len(data.translate(None, _LETTERS)),
        len(data) - len(data.translate(None, _UPPER)),
        len(data.translate(None, _PLAIN)),
        sum(map(operator.eq, words, words[1:])),
    )


def count_rules(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``rid, id`` and the counts of every row; ``rid`` names a row by id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in slices(batch, 1 << 20):
                rows = [rule_counts(t) for t in part.column(2).to_pylist()]
                columns = np.array(rows, dtype=np.int64).reshape(len(rows), len(names)).T
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(c) for c in columns)], ["rid", "id", *names]
                )

    names = (*COUNTS, *MORE_COUNTS)
    kind = df.schema[id_column].dataType.simpleString()
    chosen = df.select(
        row_key(id_column, text_column).alias("rid"), F.col(id_column).alias("id"), F.col(text_column).alias("text")
    )
    return chosen.mapInArrow(run, f"rid binary, id {kind}, " + ", ".join(f"{n} long" for n in names))


def base_failed(least_words: int = LEAST_WORDS, most_repeated: int = MOST_REPEATED) -> Column:
    """The fixed rules: too few words, or too many of them repeated (per cent)."""
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def ratios(prior: int = 20) -> list[Column]:
    """Statistics that don't grow with the length of a text; ``prior`` plain words steady those of short ones."""
    words = F.col("n_words") + prior
    one = F.lit(1.0)
    return [
        F.least((F.col("word_chars") + 5 * prior) / words, F.lit(10.0)).alias("word_length"),
        F.least(F.col("n_symbols") / words, one).alias("symbols"),
        F.least(F.col("n_marks") / words, one).alias("marks"),
        (F.col("n_upper") / (F.col("n_letters") + 5 * prior)).alias("upper"),
        (F.col("n_stutters") / words).alias("stutters"),
    ]


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length in a random tree of ``n`` rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2)
    return np.where(n > 1, 2 * (np.log(np.maximum(safe - 1, 1)) + 0.5772156649) - 2 * (safe - 1) / safe, 0.0)


@dataclass(frozen=True)
class Forest:
    """Trees as arrays; a leaf has feature -1 and its path length in ``value``."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    roots: np.ndarray
    norm: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """``2 ** (-mean path / expected path)`` of every row, near 1 for outliers."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := self.feature[at] >= 0).any():
                here = at[inner]
                below = x[rows[inner], self.feature[here]] < self.value[here]
                at[inner] = np.where(below, self.left[here], self.right[here])
            total += self.value[at]
        return 2.0 ** (-total / len(self.roots) / max(self.norm, 1e-9))


def fit_forest(
    x: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = 100, rows: int = 256, seed: int = 7
) -> Forest:
    """Isolation trees over random subsamples of ``rows`` rows of ``x``.

    Cuts are drawn over the box ``low`` to ``high`` of the whole corpus, not only over the
    rows of the subsample, so the empty space around the sampled rows is cut off early.
    """
    rng = np.random.default_rng(seed)
    feature, value, left, right, roots = [], [], [], [], []
    deepest = int(np.ceil(np.log2(max(rows, 2))))

    def grow(part: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> int:
        node = len(feature)
        feature.append(-1), value.append(0.0), left.append(-1), right.append(-1)
        able = np.flatnonzero(high > low)
        if depth >= deepest or len(part) < 2 or not able.size:
            value[node] = depth + float(_mean_path(len(part)))
            return node
        f = int(rng.choice(able))
        cut = float(rng.uniform(low[f], high[f]))
        below, under, over = part[:, f] < cut, high.copy(), low.copy()
        under[f] = over[f] = cut
        feature[node], value[node] = f, cut
        left[node] = grow(part[below], low, under, depth + 1)
        right[node] = grow(part[~below], over, high, depth + 1)
        return node

    for _ in range(trees):
        part = x[rng.choice(len(x), min(rows, len(x)), replace=False)]
        roots.append(grow(part, np.asarray(low, float), np.asarray(high, float), 0))
    return Forest(*(np.array(v) for v in (feature, value, left, right, roots)), float(_mean_path(min(rows, len(x)))))


def ratio_matrix(counts: dict[str, np.ndarray], prior: int = 20) -> np.ndarray:
    """The statistics of ``ratios`` from arrays of counts."""
    words = counts["n_words"] + float(prior)
    return np.column_stack(
        [
            np.minimum((counts["word_chars"] + 5 * prior) / words, 10.0),
            np.minimum(counts["n_symbols"] / words, 1.0),
            np.minimum(counts["n_marks"] / words, 1.0),
            counts["n_upper"] / (counts["n_letters"] + 5.0 * prior),
            counts["n_stutters"] / words,
        ]
    )


def forest_scores(counts: DataFrame, forest: Forest, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``score`` of every row."""
    shared = counts.sparkSession.sparkContext.broadcast(forest)  # its size is set by trees and rows a tree
    names = (*COUNTS, *MORE_COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            found = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(names)}
            score = pa.array(shared.value.score(ratio_matrix(found)))
            yield pa.RecordBatch.from_arrays([*batch.columns[len(names) :], score], [*keep, "score"])

    kinds = dict(counts.dtypes)
    shape = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", score double"
    kept = [F.col(c).alias(f"__{c}") for c in keep]
    return counts.select(*names, *kept).mapInArrow(run, shape)


def calibrated(scored: DataFrame, good_kept: float = 0.995, default: float = 0.6, bins: int = 10_000) -> float:
    """The score up to which a document is kept, from all rows with ``good`` true or false.

    Of the thresholds that keep ``good_kept`` of the good rows or more, the one with the
    best mean of good rows kept and bad rows rejected.
    """
    cell = F.floor(F.col("score") * bins).cast("int").alias("cell")
    count = scored.groupBy(cell).agg(
        F.sum(F.col("good").cast("int")).alias("good"), F.sum((~F.col("good")).cast("int")).alias("bad")
    )
    good, bad = np.zeros(bins + 1), np.zeros(bins + 1)
    for row in count.collect():  # at most one row for each cell
        good[row["cell"]], bad[row["cell"]] = row["good"] or 0, row["bad"] or 0
    if not good.sum() or not bad.sum():
        return default
    kept, rejected = np.cumsum(good) / good.sum(), 1 - np.cumsum(bad) / bad.sum()
    balance = np.where(kept >= good_kept, kept + rejected, -1)
    best = np.flatnonzero(balance >= balance.max() - 1e-12)
    return float(best[len(best) // 2] + 1) / bins


def fitted(
    counts: DataFrame,
    labels: DataFrame | None,
    sample_rows: int = 8192,
    good_kept: float = 0.995,
    default_threshold: float = 0.6,
) -> tuple[Forest, float] | None:
    """Forest and threshold from staged counts; None if the fixed rules pass no row."""
    passed = counts.filter(~base_failed())
    sampled = passed
    if labels is not None:
        known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("__label"))
        known = known.agg((F.min("quality") > 0).alias("good"))
        passed_known = passed.join(known, F.col("id") == F.col("__label")).drop("__label")
        good = passed_known.filter("good").drop("good")
        sampled = passed if good.isEmpty() else good
    # four times the sample by hash first, so that tasks send the driver no more than that in all
    share = min(1.0, 4 * sample_rows / max(sampled.count(), 1))
    drawn = sampled.filter(F.abs(F.xxhash64("rid") / F.lit(2.0**63)) <= share)
    names = (*COUNTS, *MORE_COUNTS)
    rows = drawn.orderBy(F.xxhash64("rid"), "rid").limit(sample_rows).select(*names).collect()
    if not rows:
        return None
    of_rows = ratio_matrix(dict(zip(names, np.array(rows, dtype=float).T)))
    wide = counts.select(*ratios())
    ends = wide.agg(*[F.min(n) for n in wide.columns], *[F.max(n) for n in wide.columns]).first()
    half = len(wide.columns)
    forest = fit_forest(of_rows, np.array(ends[:half]), np.array(ends[half:]))
    if labels is None:
        return forest, default_threshold
    return forest, calibrated(forest_scores(passed_known, forest, ["good"]), good_kept, default_threshold)


def judge(
    df: DataFrame, labels: DataFrame | None, id_column: str = "doc_id", text_column: str = "text", **options
) -> DataFrame:
    """``rid, id``, all counts, ``base_failed``, ``score`` and ``kept`` of every row.

    ``labels`` has ``doc_id`` and ``quality`` (1 good, 0 bad). ``options`` are those of
    ``fitted``; its ``sample_rows`` bounds the rows the forest is fitted on. The counts are
    staged in the shared folder.
    """
    counts = stage(count_rules(df, id_column, text_column))
    failed = counts.withColumn("base_failed", base_failed())
    found = fitted(counts, labels, **options)
    if found is None:
        verdict = F.lit(None).cast("double")
        return failed.withColumn("score", verdict).withColumn("kept", ~F.col("base_failed"))
    forest, threshold = found
    scored = forest_scores(failed, forest, failed.columns)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") < threshold))


def keep_good(
    df: DataFrame, labels: DataFrame | None, id_column: str = "doc_id", text_column: str = "text", **options
) -> DataFrame:
    """``df`` without the rows that ``judge`` rejects; texts are judged where they are read, none is shuffled."""
    counts = stage(count_rules(df, id_column, text_column))
    found = fitted(counts, labels, **options)
    unstage(counts)
    shared = df.sparkSession.sparkContext.broadcast(found)
    names, at = (*COUNTS, *MORE_COUNTS), df.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in slices(batch, 1 << 20):
                rows = [rule_counts(t) for t in part.column(at).to_pylist()]
                of = dict(zip(names, np.array(rows, dtype=np.int64).reshape(len(rows), len(names)).T))
                good = (of["n_words"] >= LEAST_WORDS) & (100 * of["n_repeat_words"] <= MOST_REPEATED * of["n_words"])
                if shared.value is not None:
                    forest, threshold = shared.value
                    good &= forest.score(ratio_matrix(of)) < threshold
                yield part.filter(pa.array(good))

    return df.mapInArrow(run, df.schema)
