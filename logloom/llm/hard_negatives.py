"""Hard negatives by anchor-clustered shared lists, in the manner of MAXIMUS.

Anchors are clustered by direction. For a cluster, a candidate at angle ``t`` from its centre scores at
most ``|candidate| * cos(max(0, t - radius))`` with a member of length 1, the radius being the widest angle between
centre and members. Candidates are sorted by this bound once for each cluster; every member walks the shared
list from its top and stops where the bound times its own length is below what it still needs, which
certifies that nothing behind can count.

The list of a cluster lies in pieces: candidates are dealt to chunks, and a task walks one chunk for a few clusters. What a
member needs is first found from one chunk in ``probe`` (any rows give a valid need), then all
chunks are walked. Positives come first; their scores give the windows in which the second walk
finds negatives. Scores are integer products and exact while they are below 2 ** 53.

Centres are fitted on a hash-drawn sample of at most ``sample_rows`` anchors; they decide the work,
never the result. A cluster of more than ``members`` anchors is split.

Defined results: rows with a null label, a null or empty vector, null or non-finite components
or a null id take no part, nor do vectors of another length than most have; of rows with one id the smallest
label and vector count; zero vectors take part; ties go to the smaller id; an anchor without positives or
negatives gives no rows; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.session import stage, unstage

_STEP = 512
_FOUND = "a long, p long, id long, score long"
_NONE = -(1 << 62)


def _packed(rows: DataFrame) -> DataFrame:
    """``id, label, z``: components as doubles in bytes, whole numbers all."""

    def run(batches):
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 0))
            raw = pa.array([r.tobytes() for r in flat], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), raw], ["id", "label", "z"])

    return rows.select("id", "label", "z").mapInArrow(run, "id long, label long, z binary")


def _matrix(raw) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def fit_centres(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """``k`` directions that vectors ``x`` gather around."""
    x = _unit(x)
    centres = x[np.linspace(0, len(x) - 1, k).astype(np.int64)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        moved = _unit(sums)
        centres = np.where(np.abs(moved).sum(axis=1, keepdims=True) > 0, moved, centres)
    return centres


def _clustered(anchors: DataFrame, k: int, members: int, sample_rows: int) -> tuple[DataFrame, Column, int]:
    """Staged ``anchors`` with the nearest centre, their block of some ``members`` anchors at most, and the number of blocks."""
    sample = anchors.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("z").collect()
    centres = anchors.sparkSession.sparkContext.broadcast(fit_centres(_matrix([r["z"] for r in sample]), k))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                near = (_unit(_matrix(batch.column(2).to_pylist())) @ centres.value.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], ["id", "label", "z", "near"])

    placed = stage(anchors.select("id", "label", "z").mapInArrow(run, "id long, label long, z binary, near int"))
    sizes = [0] * k  # k is bounded
    for r in placed.groupBy("near").count().collect():
        sizes[r["near"]] = -(-r["count"] // members)
    first = np.cumsum([0, *sizes]).tolist()
    start, size = (F.element_at(F.array(*[F.lit(int(x)) for x in xs]), F.col("near") + 1) for xs in (first[:-1], sizes))
    block = start + F.pmod(F.xxhash64(F.lit("part"), "id"), size).cast("int")
    return placed, block.alias("block"), first[-1]


def _walk(candidates: pd.DataFrame, asked: pd.DataFrame, k: int, same: bool) -> pd.DataFrame:
    """The best ``k`` of the candidates for each target ``(a, p)`` that can still count, by sorted bounds."""
    ids, labels = candidates["id"].to_numpy(), candidates["label"].to_numpy()
    z = _matrix(candidates["z"].tolist())
    length = np.linalg.norm(z, axis=1)
    direction = _unit(z)
    out = []
    for _, targets in asked.groupby("block", sort=True):
        targets = targets.sort_values(["a", "p"])
        own, of = np.unique(targets["a"].to_numpy(), return_index=True)
        x = _matrix(targets["z"].iloc[of].tolist())
        member = np.searchsorted(own, targets["a"].to_numpy())
        mine, low, high = (targets[c].to_numpy() for c in ("label", "low", "high"))
        need = np.maximum(targets["need"].to_numpy(), low)
        size, unit = np.linalg.norm(x, axis=1), _unit(x)
        centre = _unit(unit.sum(axis=0))
        if not centre.any():
            radius = np.pi
        else:
            radius = np.arccos(np.clip(unit[size > 0] @ centre, -1, 1)).max(initial=0)
        angle = np.arccos(np.clip(direction @ centre, -1, 1))
        bound = length * np.cos(np.maximum(angle - radius, 0))
        order = np.lexsort((ids, -bound))
        slack = 1e-9 * length.max(initial=0)
        best = [np.empty(0, np.int64) for _ in range(3)]  # target, score, place of the candidate
        for at in range(0, len(order), _STEP):
            able = size[member] * (bound[order[at]] + slack) + 1e-6 >= need
            able = np.flatnonzero(able)
            if not able.size:
                break
            here = order[at : at + _STEP]
            used = np.unique(member[able])
            scores = np.rint(x[used] @ z[here].T).astype(np.int64)[np.searchsorted(used, member[able])]
            alike = labels[here][None, :] == mine[able][:, None]
            ok = (scores >= need[able][:, None]) & (scores <= high[able][:, None]) & (alike == same)
            ok &= ids[here][None, :] != targets["a"].to_numpy()[able][:, None]
            row, column = np.nonzero(ok)
            if not row.size:
                continue
            t = np.concatenate([best[0], able[row]])
            s = np.concatenate([best[1], scores[row, column]])
            c = np.concatenate([best[2], here[column]])
            rank = np.lexsort((ids[c], -s, t))
            t, s, c = t[rank], s[rank], c[rank]
            start = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            place = np.arange(len(t)) - np.repeat(start, np.diff(np.r_[start, len(t)]))
            keep = place < k
            t, s, c = best = [v[keep] for v in (t, s, c)]
            full = place[keep] == k - 1
            need[t[full]] = np.maximum(need[t[full]], s[full])
        t, s, c = best
        a, p = (targets[n].to_numpy()[t] for n in ("a", "p"))
        out.append(pd.DataFrame({"a": a, "p": p, "id": ids[c], "score": s}))
    return pd.concat(out) if out else pd.DataFrame({c: np.empty(0, np.int64) for c in ("a", "p", "id", "score")})


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("a", "p").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _searched(
    candidates: DataFrame, targets: DataFrame, chunks: int, groups: int, k: int, same: bool, probe: int
) -> DataFrame:
    """Staged ``a, p, id, score, rank`` of all targets, exactly the best ``k``."""

    def walk(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if own.empty or asked.empty:
            return pd.DataFrame({c: np.empty(0, np.int64) for c in ("a", "p", "id", "score")})
        return _walk(own, asked, k, same)

    def walked(asked: DataFrame, step: int) -> DataFrame:
        every = F.sequence(F.lit(0), F.lit(chunks - 1), F.lit(step))
        sent = asked.withColumn("grp", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).withColumn("chunk", F.explode(every))
        lists = candidates.filter(F.col("chunk") % step == 0)
        lists = lists.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        return lists.groupBy("chunk", "grp").cogroup(sent.groupBy("chunk", "grp")).applyInPandas(walk, _FOUND)

    first = _ranked(walked(targets.withColumn("need", F.lit(_NONE).cast("long")), probe), k)
    known = stage(first.filter(F.col("rank") == k).select("a", "p", F.col("score").alias("need")))
    asked = targets.join(known, ["a", "p"], "left").withColumn("need", F.coalesce("need", F.lit(_NONE).cast("long")))
    result = stage(_ranked(walked(asked, 1), k))
    unstage(known)
    return result


def mine(
    df: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    members: int = 128,
    chunk_rows: int = 4096,
    sample_rows: int = 8192,
    probe: int = 16,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for rows with ``is_anchor`` (on column ``id``).

    Negatives have another label and ``low`` to ``high`` percent of the positive's score.
    """
    vec = F.col(vector_column).cast("array<double>")
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"), vec.alias("z"))
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL AND z IS NOT NULL AND size(z) > 0")
    rows = rows.filter(F.forall("z", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    rows = stage(rows.groupBy("id").agg(F.min(F.struct("label", "z")).alias("x")).select("id", "x.label", "x.z"))
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    most = rows.groupBy(F.size("z").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if most is None:
        return df.sparkSession.createDataFrame([], empty)
    # floor gives whole numbers; as doubles, their products are exact below 2 ** 53
    whole = F.transform("z", lambda x: F.floor(x * scale).cast("double"))
    table = rows.filter(F.size("z") == most["d"]).withColumn("z", whole)
    chunks = -(-most["count"] // chunk_rows)
    candidates = stage(_packed(table).withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")))
    anchors = candidates.filter(is_anchor)
    n = anchors.count()
    if not n:
        return df.sparkSession.createDataFrame([], empty)
    placed, block, blocks = _clustered(anchors, max(1, min(256, n // 64)), members, sample_rows)
    groups = -(-blocks // 16)
    of_anchor = placed.select(F.col("id").alias("a"), "label", "z", block)
    widest = [F.lit(x).cast("long").alias(c) for c, x in (("low", _NONE), ("high", -_NONE))]
    first = _searched(
        candidates, of_anchor.select("*", F.col("a").alias("p"), *widest), chunks, groups, positives, True, probe
    )
    wins = first.select("a", F.col("id").alias("p"), F.col("score").alias("ps"))
    window = [F.ceil(F.col("ps") * low / 100).cast("long").alias("low"), F.floor(F.col("ps") * high / 100).cast("long").alias("high")]
    targets = wins.join(of_anchor, "a").select("a", "p", "label", "z", "block", *window).filter("low <= high")
    second = _searched(candidates, targets, chunks, groups, negatives, False, probe)
    out = second.join(wins, ["a", "p"]).select(
        F.col("a").alias("anchor_id"), F.col("p").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"), F.col("ps").alias("positive_score"), F.col("score").alias("negative_score"),
    )
    out = stage(out)
    unstage(rows, candidates, placed, first, second)
    return out
