"""Exact nearest neighbours and the local outlier factor (Breunig et al., SIGMOD 2000).

Points are split around pivots, level by level, until no leaf holds more than a bounded number of
them. Leaves that lie next to each other in the tree share a home, and a point meets its own home first, which
gives a bound for its ``k``-th distance; then it meets those leaves only whose ball reaches nearer than that
bound. Leaves ask for their points together: the tree is descended once a leaf, and points are moved once
for each block of leaves that asks for them, not once a point. Pairs of points are never written out,
and no partner is dropped that could change the result.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from logloom.operators.quantiles import quantile_row
from logloom.session import durable

HOME_BYTES, BLOCK_BYTES = 8 << 20, 16 << 20  # of vectors as doubles: what meets at first, and what asks together, two blocks at a time
_NEAR = "id long, other long, dist double"
_FOUND = "leaf string, ids array<long>, others array<long>, dists binary"
_CARD = f"{_FOUND}, home int, block int, vectors binary, centre array<double>, far double, reach double"
_ID, _NULL, _AT_HOME = 0, 1, 2


def _distance(a: Column | str, b: Column | str) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def pivot_tree(points: DataFrame, block: int, fan: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Points ``(id, x)`` -> ``(id, x, leaf)`` and the nodes ``(parent, node, centre, far, leaf)``.

    A node with more than ``block`` points is split around as many of them as make leaves of half a block on average, ``fan``
    at most, drawn by hash. Where all drawn points are equal, as among copies, it is dealt out evenly. ``far`` is the
    radius of a node around ``centre``.
    """
    here = durable(points.select("id", "x", F.lit("").alias("node")))
    kind = here.schema["x"].dataType.simpleString()
    placed, nodes, level = None, None, 0
    while True:
        sizes = here.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        big = sizes.filter(F.col("n") > block)
        if level:
            done = here.join(sizes.filter(F.col("n") <= block).select("node"), "node", "left_semi")
            placed = done if placed is None else placed.unionByName(done)
            here = here.join(big.select("node"), "node", "left_semi")
        if level and big.isEmpty():
            break
        # a big node meets its pivots in parts
        n = F.col("n") / block
        parts = durable(sizes.select(
            "node", F.ceil(n).cast("int").alias("split"), F.ceil(n / 8).cast("int").alias("parts"),
            F.least(F.lit(fan), F.greatest(F.lit(4), F.ceil(2 * n).cast("int"))).alias("fan"),
        ))
        here = here.join(parts, "node")
        slot = F.pmod(F.xxhash64("id", F.lit(seed + level)), F.col("fan")).cast("int")
        first = F.struct(F.xxhash64("id", F.lit(seed - 1 - level)).alias("h"), F.col("id").alias("i"))
        drawn = here.groupBy("node", "parts", slot.alias("slot")).agg(F.min_by("x", first).alias("centre"))
        drawn = durable(drawn)
        pivots = drawn.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = here.withColumn("part", F.pmod(F.xxhash64("id", "x"), F.col("parts")).cast("int"))
        next_ = durable(
            dealt.select("id", "x", "node", "part", "split").groupBy("node", "part")
            .cogroup(pivots.select("node", "slot", "centre", "part").groupBy("node", "part"))
            .applyInArrow(_to_pivots, f"id long, x {kind}, node string, slot int, child string, d double")
        )
        made = next_.groupBy("node", "child").agg(F.first("slot").alias("slot"), F.max("d").alias("far"), (F.count(F.lit(1)) <= block).alias("leaf"))
        made = made.join(drawn.select("node", "slot", "centre"), ["node", "slot"])
        made = durable(made.select(F.col("node").alias("parent"), F.col("child").alias("node"), "centre", "far", "leaf"))
        nodes = made if nodes is None else nodes.unionByName(made)
        here, level = next_.select("id", "x", F.col("child").alias("node")), level + 1
    return placed.withColumnRenamed("node", "leaf"), nodes


def _to_pivots(points: pa.Table, pivots: pa.Table) -> pa.Table:
    """The nearest pivot of each point of a node; where all pivots are equal, points are dealt out."""
    x, node = _matrix(points["x"]).astype("float64"), points["node"][0].as_py()
    pivots = pivots.sort_by("slot")
    slots, centres = pivots["slot"].to_numpy(), _matrix(pivots["centre"]).astype("float64")
    with np.errstate(over="ignore"):
        d = np.stack([np.sqrt(((x - c) ** 2).sum(axis=1)) for c in centres], axis=1)
    near = d.argmin(axis=1)
    child = slots[near]
    if (centres == centres[0]).all():
        child = (np.arange(len(x)) + pivots["part"][0].as_py()) % points["split"][0].as_py()
    return pa.table({
        "id": points["id"], "x": points["x"], "node": points["node"], "slot": pa.array(slots[near], pa.int32()),
        "child": pa.array([f"{node}/{c}" for c in child], pa.string()), "d": d[np.arange(len(x)), near],
    })


def leaf_visits(asking: DataFrame, nodes: DataFrame, levels: int) -> DataFrame:
    """``id, leaf`` for the leaves, besides its own, that may hold a nearer point than ``bound`` for each of ``asking``."""
    found = None
    asking = asking.select("id", "x", "bound", F.col("leaf").alias("own"))
    frontier = asking.select("id", F.lit("").alias("node"))
    below = nodes.withColumnRenamed("node", "child").withColumnRenamed("parent", "node")
    for _ in range(levels):
        reached = _distance("x", "centre") * (1 - 1e-12) - F.col("far") < F.col("bound")
        met = frontier.join(asking, "id").join(below, "node").filter(reached)
        met = durable(met.filter("child <> own").select("id", F.col("child").alias("node"), "leaf"))
        visits = met.filter("leaf").select("id", F.col("node").alias("leaf"))
        found = visits if found is None else found.unionByName(visits)
        frontier = met.filter("NOT leaf").drop("leaf")
    return found


def nearest_neighbours(df: DataFrame, key: str, features: str, k: int, block: int = 2000, fan: int = 16, seed: int = 3) -> DataFrame:
    """Rows ``(id, other, dist)``: the ``k`` nearest other rows of each row (Euclidean).

    ``key`` is a unique bigint column, ``features`` an array of numbers. Equal distances
    are resolved by the smaller id among the leaves that were met. Rows without a vector of finite numbers
    are at no distance from any other and take no part.
    """
    points = df.select(F.col(key).cast("bigint").alias("id"), F.col(features).alias("x"))
    if not isinstance(points.schema["x"].dataType.elementType, FloatType):
        points = points.withColumn("x", F.col("x").cast("array<double>"))
    finite = F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    kind = "<f4" if points.schema["x"].dataType.elementType == FloatType() else "<f8"
    placed, nodes = pivot_tree(points.filter(finite), block, fan, seed)
    # leaves are dealt in the order of the tree; this window has one row a leaf
    sizes = placed.groupBy("leaf").agg(F.sum(8 * F.size("x")).alias("bytes"))
    before = F.sum("bytes").over(Window.orderBy("leaf")) - F.col("bytes")
    dealt = durable(sizes.select("leaf", F.floor(before / HOME_BYTES).cast("int").alias("home"), F.floor(before / BLOCK_BYTES).cast("int").alias("block")))
    cards = durable(placed.join(dealt, "leaf").groupBy("home").applyInArrow(lambda t: _at_home(t, k, kind), _CARD))
    found = cards.select("leaf", "ids", "others", "dists")
    levels = nodes.agg(F.max(F.size(F.split("node", "/")))).first()[0] or 0
    if levels > 1:
        asking = cards.select(F.col("leaf").alias("id"), F.col("centre").alias("x"), (F.col("far") + F.col("reach")).alias("bound"), "leaf")
        visits = leaf_visits(durable(asking), nodes, levels - 1)
        asks = dealt.select(F.col("leaf").alias("id"), F.col("home").alias("of"), F.col("block").alias("asking"))
        wanted = visits.join(asks, "id").join(dealt, "leaf").filter("home <> of")
        wanted = durable(wanted.select("asking", F.floor(F.col("block") / 2).alias("asked"), "leaf").distinct())
        moved = ["asking", "asked", "leaf", "home", "ids", "dists", "vectors", "centre", "far"]
        answers = wanted.join(cards, "leaf").select(*moved)
        asking = wanted.select("asking", "asked").distinct().join(cards.withColumn("asking", F.col("block")), "asking").select(*moved).toDF(*moved)
        met = (
            asking.groupBy("asking", "asked").cogroup(answers.groupBy("asking", "asked"))
            .applyInArrow(lambda a, b: _abroad(a, b, kind), _FOUND)
        )
        found = found.unionByName(met)
    near = found.groupBy("leaf").applyInArrow(lambda t: _united(t, k), _NEAR)
    rank = Window.partitionBy("id").orderBy("dist", "other")
    return near.withColumn("place", F.row_number().over(rank)).filter(F.col("place") <= k).drop("place")


@dataclass
class _Leaf:
    """Points of a leaf, a ball around them, and the ``k`` nearest rows found for each so far."""

    name: str
    home: int
    ids: np.ndarray
    known: np.ndarray  # False where the id is null
    x: np.ndarray
    centre: np.ndarray
    far: float
    dist: np.ndarray | None = None
    other: np.ndarray | None = None
    mark: np.ndarray | None = None  # what ``other`` is: an id, a null id, or a row found at home

    def take(self, row: np.ndarray, dist: np.ndarray, other: np.ndarray, mark: np.ndarray) -> None:
        """Take what was found for the rows ``row`` into their ``k`` nearest."""
        if not len(row):
            return
        k = self.dist.shape[1]
        rows, place = np.unique(row, return_inverse=True)
        at = np.concatenate([np.repeat(np.arange(len(rows)), k), place])
        dist = np.concatenate([self.dist[rows].ravel(), dist])
        other = np.concatenate([self.other[rows].ravel(), other])
        mark = np.concatenate([self.mark[rows].ravel(), mark])
        order = np.lexsort((other, dist, at))
        best = order[np.searchsorted(at[order], np.arange(len(rows)))[:, None] + np.arange(k)]
        self.dist[rows], self.other[rows], self.mark[rows] = dist[best], other[best], mark[best]

    def found(self) -> dict:
        """What was found beyond home, as a row; what is at no finite distance is a free place."""
        dist = np.where(self.mark == _AT_HOME, np.inf, self.dist)
        return {
            "leaf": self.name, "ids": pa.array(self.ids, mask=~self.known),
            "others": pa.array(self.other.ravel(), mask=self.mark.ravel() != _ID), "dists": dist.tobytes(),
        }


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    flat, lengths = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("vectors of different lengths")
    return flat.reshape(len(lengths), -1)


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values, and where they aren't null."""
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _rows(rows: list[dict], schema: dict[str, pa.DataType]) -> pa.Table:
    """Arrays go into lists by their buffers."""

    def column(name: str, kind: pa.DataType) -> pa.Array:
        values = [r[name] for r in rows]
        if not pa.types.is_list(kind):
            return pa.array(values, kind)
        ends = np.cumsum([0, *map(len, values)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays([pa.array([], kind.value_type), *values]))

    return pa.table({name: column(name, kind) for name, kind in schema.items()})


_FOUND_ARROW = {"leaf": pa.string(), "ids": pa.list_(pa.int64()), "others": pa.list_(pa.int64()), "dists": pa.binary()}
_CARD_ARROW = {
    **_FOUND_ARROW, "home": pa.int32(), "block": pa.int32(), "vectors": pa.binary(),
    "centre": pa.list_(pa.float64()), "far": pa.float64(), "reach": pa.float64(),
}


def _at_home(points: pa.Table, k: int, kind: str) -> pa.Table:
    """Leaves of one home, with the ``k`` nearest rows there for each of their points."""
    names = points["leaf"].combine_chunks().dictionary_encode()
    code = names.indices.to_numpy(zero_copy_only=False)
    ids, known = _numbers(points["id"].combine_chunks())
    order = np.lexsort((ids, ~known, code))
    code, ids, known, x = code[order], ids[order], known[order], _matrix(points["x"])[order].astype(kind)
    home, block = points["home"][0].as_py(), points["block"][0].as_py()
    ends = np.searchsorted(code, np.arange(len(names.dictionary) + 1))
    leaves = []
    for i, name in enumerate(names.dictionary.to_pylist()):
        some = slice(ends[i], ends[i + 1])
        centre, far = _ball(x[some].astype("float64"))
        leaves.append(_Leaf(name, home, ids[some], known[some], x[some], centre, far))
    rows = []
    for leaf in leaves:
        leaf.dist = np.full((len(leaf.ids), k), np.inf)
        leaf.other, leaf.mark = np.zeros(leaf.dist.shape, "int64"), np.zeros(leaf.dist.shape, "int8")
        own = leaf.x.astype("float64")
        _compare(leaf, own, np.arange(len(own)), own, leaf.ids, leaf.known)
        _search(leaf, [other for other in leaves if other is not leaf])
        rows.append({
            **leaf.found(), "home": home, "block": block, "vectors": leaf.x.tobytes(), "centre": pa.array(leaf.centre),
            "far": leaf.far, "reach": leaf.dist[:, -1].max(),
        })
    return _rows(rows, _CARD_ARROW)


def _abroad(asking: pa.Table, asked: pa.Table, kind: str) -> pa.Table:
    """What the leaves asked hold for points of the leaves that ask, where it is nearer than what these found at home."""
    rows, leaves = [], [*_leaves(asked, kind)]
    for leaf in _leaves(asking, kind):
        leaf.other, leaf.mark = np.zeros(leaf.dist.shape, "int64"), np.full(leaf.dist.shape, _AT_HOME, "int8")
        _search(leaf, [other for other in leaves if other.home != leaf.home])
        if (leaf.mark != _AT_HOME).any():
            rows.append(leaf.found())
    return _rows(rows, _FOUND_ARROW)


def _united(found: pa.Table, k: int) -> pa.Table:
    """The ``k`` nearest of what was found for each point of a leaf, as rows ``(id, other, dist)``."""
    ids, known = _numbers(found["ids"][0].values)
    best = None
    for others, dists in zip(found["others"], found["dists"], strict=True):
        other, real = _numbers(others.values)
        here = [np.frombuffer(dists.as_buffer(), "<f8"), other, real]
        here = [part.reshape(len(ids), k) for part in here]
        if best is not None:
            both = [np.concatenate(parts, axis=1) for parts in zip(best, here, strict=True)]
            order = np.lexsort((both[1], both[0]), axis=1)[:, :k]
            here = [np.take_along_axis(part, order, axis=1) for part in both]
        best = here
    dist, other, real = best
    row, place = np.nonzero(np.isfinite(dist))
    return pa.table({
        "id": pa.array(ids[row], mask=~known[row]), "other": pa.array(other[row, place], mask=~real[row, place]),
        "dist": dist[row, place],
    })


def _leaves(cards: pa.Table, kind: str) -> Iterable[_Leaf]:
    for i in range(len(cards)):
        card = {name: cards[name][i] for name in ("leaf", "home", "ids", "vectors", "centre", "far", "dists")}
        ids, known = _numbers(card["ids"].values)
        x = np.frombuffer(card["vectors"].as_buffer(), kind).reshape(len(ids), -1)
        dist = np.frombuffer(card["dists"].as_buffer(), "<f8").reshape(len(ids), -1)
        yield _Leaf(card["leaf"].as_py(), card["home"].as_py(), ids, known, x, card["centre"].values.to_numpy(), card["far"].as_py(), dist.copy())


def _ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    """The row nearest to the middle, and a radius around it that holds all rows: 0 for copies."""
    with np.errstate(all="ignore"):
        centre = x[((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin()]
        return centre, float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max() * (1 + 1e-12))


def _compare(leaf: _Leaf, own: np.ndarray, rows: np.ndarray, x: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
    """Take the nearest of the rows ``x`` for the points ``rows`` of a leaf."""
    order = np.lexsort((ids, ~known))
    x, ids, known = x[order], ids[order], known[order]
    for start in range(0, len(rows), 64):
        some = rows[start : start + 64]
        left_out = (leaf.ids[some, None] == ids) & leaf.known[some, None] & known
        row, col, dist = _nearest(own[some], x, left_out, leaf.dist.shape[1])
        row, col, dist = (part[np.isfinite(dist)] for part in (row, col, dist))
        leaf.take(some[row], dist, ids[col], np.where(known[col], _ID, _NULL).astype("int8"))


def _search(leaf: _Leaf, others: list[_Leaf]) -> None:
    """Take rows of other leaves, nearest leaves first, where they are nearer than what a point has so far.

    Squares from a product in single precision tell which rows may be, within a bound of its rounding; the distances of
    these are taken by differences. Where that tells little, all are compared.
    """
    if not others:
        return
    own, wide = leaf.x.astype("float64"), leaf.x.shape[1]
    with np.errstate(all="ignore"):
        offset, there = own - leaf.centre, np.stack([other.centre for other in others]) - leaf.centre
        sizes, apart = (offset * offset).sum(axis=1)[:, None], (there * there).sum(axis=1)[None, :]
        far = np.array([other.far for other in others])
        squares = (sizes + apart) * (1 - 1e-15 * (wide + 8)) - 2 * offset @ there.T
        least = np.sqrt(np.maximum(squares, 0)) - far  # no row of that leaf is nearer
        scale = max(leaf.far, (np.sqrt(apart[0]) + far).max())
    single = 1e-140 < scale < 1e140
    if single:
        offset, sizes = (offset / scale).astype("float32"), sizes[:, 0] / scale**2
    slack, space = 2.0**-22 * (wide + 10), None
    waiting = [*np.argsort(least.min(axis=0), kind="stable")[::-1]]
    while waiting:
        some, n = [], 0
        while waiting and n < 2048:
            at = waiting.pop()
            if not (least[:, at] >= leaf.dist[:, -1]).all():
                some.append(at)
                n += len(others[at].ids)
        if not some:
            return
        rows = np.flatnonzero(~(least[:, some] >= leaf.dist[:, -1:]).all(axis=1))
        x = np.concatenate([others[at].x for at in some]).astype("float64")
        ids, known = (np.concatenate([getattr(others[at], part) for at in some]) for part in ("ids", "known"))
        if not single:
            _compare(leaf, own, rows, x, ids, known)
            continue
        # a point's row times another's is their square distance less the limit; columns are filled up to whole words
        limit = (leaf.dist[rows, -1] / scale) ** 2 * (1 + slack) - sizes[rows] * (1 - slack) + 1e-30
        left = np.empty((len(rows), wide + 2), "float32")
        left[:, :-2], left[:, -2], left[:, -1] = -2 * offset[rows], 1, -np.minimum(limit, 1e30)
        near = (x - leaf.centre) / scale
        right = np.zeros((-(-n // 8) * 8, wide + 2), "float32")
        right[:n, :-2], right[:, -2], right[:, -1] = near, 3e38, 1
        right[:n, -2] = np.einsum("ij,ij->i", near, near) * (1 - slack)
        step = max(1, (1 << 20) // len(right))
        if space is None or len(space) < step * len(right):
            space = np.empty(max(1 << 20, len(right)), "float32")
        pairs = []
        for start in range(0, len(rows), step):
            part = left[start : start + step]
            product = np.matmul(part, right.T, out=space[: len(part) * len(right)].reshape(len(part), len(right)))
            hit = (product <= 0).reshape(-1, 8)
            words = np.flatnonzero(hit.view("uint64"))
            if 16 * len(words) > len(hit):
                _compare(leaf, own, rows[start : start + step], x, ids, known)
                continue
            word, bit = np.nonzero(hit[words])
            row, col = np.divmod(words[word] * 8 + bit, len(right))
            pairs.append((rows[start + row], col))
        row, col = (np.concatenate([pair[side] for pair in pairs] or [rows[:0]]) for side in (0, 1))
        for start in range(0, len(row), 20000):
            r, c = row[start : start + 20000], col[start : start + 20000]
            dist = np.sqrt(((own[r] - x[c]) ** 2).sum(axis=1))
            kept = (dist <= leaf.dist[r, -1]) & np.isfinite(dist) & ~((leaf.ids[r] == ids[c]) & leaf.known[r] & known[c])
            r, c = r[kept], c[kept]
            leaf.take(r, dist[kept], ids[c], np.where(known[c], _ID, _NULL).astype("int8"))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2), 0.0))


def _nearest(a: np.ndarray, b: np.ndarray, left_out: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of ``a``, row of ``b`` and distance of the ``k`` nearest rows of ``b`` for each of ``a``, equal ones in the order of ``b``.

    Squares from one matrix product tell which rows may be among them, within a bound of its rounding; the
    distances of these are taken by differences. Where a square isn't finite or the bound tells little, all are.
    """
    with np.errstate(all="ignore"):
        sizes, others = (a * a).sum(axis=1), (b * b).sum(axis=1)
        squares = sizes[:, None] + others[None, :] - 2.0 * (a @ b.T)
        slack = 1e-14 * a.shape[1] * (sizes + others.max())
    if len(b) > 2 * k and np.isfinite(squares).all() and np.isfinite(slack).all():
        squares[left_out] = np.inf
        edge = np.partition(squares, k - 1, axis=1)[:, k - 1]
        row, col = np.nonzero(squares <= (edge + 2 * slack)[:, None])
        if 4 * len(row) < squares.size:
            dist = np.sqrt(((a[row] - b[col]) ** 2).sum(axis=1))
            dist[left_out[row, col]] = np.inf
            order = np.lexsort((col, dist, row))
            row, col, dist = row[order], col[order], dist[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            return row[place < k], col[place < k], dist[place < k]
    d = _distances(a, b)
    d[left_out] = np.inf
    best = np.argsort(d, axis=1, kind="stable")[:, :k]
    return np.repeat(np.arange(len(a)), best.shape[1]), best.ravel(), np.take_along_axis(d, best, axis=1).ravel()


def local_outlier_factor(df: DataFrame, key: str, features: str, k: int = 20, **options) -> DataFrame:
    """Rows ``(id, lof)``: near 1 is as dense as the neighbourhood, larger is more isolated."""
    near = durable(nearest_neighbours(df, key, features, k, **options))
    reach_of = near.groupBy("id").agg(F.max("dist").alias("k_dist"))
    reach = near.join(
        reach_of.withColumnRenamed("id", "other"), "other"
    ).withColumn("reach", F.greatest("dist", "k_dist"))
    density = reach.groupBy("id").agg((1.0 / (F.avg("reach") + 1e-10)).alias("lrd"))
    around = near.join(density.withColumnRenamed("id", "other"), "other").groupBy("id").agg(
        F.avg("lrd").alias("lrd_around")
    )
    return density.join(around, "id").select("id", (F.col("lrd_around") / F.col("lrd")).alias("lof"))


def flag_outliers(scored: DataFrame, contamination: float = 0.1) -> DataFrame:
    """Mark the top share of outlier factors."""
    cut = quantile_row(scored, "lof", {"q": 1.0 - contamination}).scalar()
    return scored.withColumn("is_anomaly", F.col("lof") > cut)
