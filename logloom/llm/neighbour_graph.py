"""Approximate nearest neighbours: NN-descent graph, greedy search.

Every vector gets a list of near ones from random projections first. In a round of NN-descent
the neighbours of a vector, forward and reverse, are compared with each other, and each keeps
the best it meets. A query walks the finished graph: of its best finds so far it opens those
not opened yet and scores their neighbours, until nothing better turns up.

Nearness is the inner product. The graph is built on vectors with one more component that
makes all norms equal, so that the largest product is the smallest distance; scores are those
of the original vectors. Equal vectors are one node, whose smallest ids stand for it.

Work is cut into blocks of a bounded number of nodes. A block gets its lists and each vector
they name once, so a task holds ``block_rows * (degree + reverse)`` vectors at most. Reverse
lists are random samples of that size, as NN-descent samples them; the recall is measured
against brute force in the tests.

Defined results: vectors that are null, empty, all zero or hold null or non-finite components
take no part, nor do rows with a null id and vectors of another length than most have; of rows
with one id the smallest vector counts; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.session import stage, unstage

_EDGE = "u long, v long, s float"


def _best(u: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` largest ``s`` of each ``u``, every ``v`` once."""
    order = np.lexsort((-s, v, u))
    u, v, s = u[order], v[order], s[order]
    keep = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])] if len(u) else np.empty(0, bool)
    u, v, s = u[keep], v[keep], s[keep]
    order = np.lexsort((v, -s, u))
    u, v, s = u[order], v[order], s[order]
    start = np.flatnonzero(np.r_[True, u[1:] != u[:-1]]) if len(u) else np.empty(0, np.int64)
    rank = np.arange(len(u)) - np.repeat(start, np.diff(np.r_[start, len(u)]))
    keep = rank < k
    return u[keep], v[keep], s[keep]


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """A partition, which holds a bounded number of nodes with their lists."""
    found = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(found) if found else None


def _edges_batch(u: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s.astype(np.float32))], ["u", "v", "s"])


def _top_lists(edges: DataFrame, k: int, blocks: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (part := _whole(batches)) is not None:
            yield _edges_batch(*_best(*(part.column(i).to_numpy() for i in range(3)), k))

    return edges.repartition(blocks, "u").mapInArrow(run, _EDGE)


def _matrix(raw, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=np.float16).reshape(-1, dim).astype(np.float32)


def _packed(nodes: DataFrame, most: float) -> DataFrame:
    """``c, z``: half-precision vectors, scaled to norms of at most 1, with the norm-equalising component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1) / most
            more = np.sqrt(np.maximum(1 - (x * x).sum(axis=1), 0))
            z = np.column_stack([x, more]).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in z], pa.binary())], ["c", "z"])

    return nodes.select("c", "vec").mapInArrow(run, "c long, z binary")


def _first_lists(nodes: DataFrame, packed: DataFrame, dim: int, degree: int, blocks: int, rounds: int, seed: int) -> DataFrame:
    """Edges to the nearest of some hundred nodes beside each in random projections."""
    rng = np.random.default_rng(seed)
    both = nodes.select("c", "vec").join(packed, "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _whole(batches)
        if part is None:
            return
        ids, x = part.column(0).to_numpy(), _matrix(part.column(1).to_pylist(), dim + 1)
        ends = [*range(512, len(ids) - 256, 512), len(ids)]
        start = 0
        for end in ends:
            own, near = ids[start:end], x[start:end] @ x[start:end].T
            np.fill_diagonal(near, -np.inf)
            k = min(degree, len(own) - 1)
            if k > 0:
                at = np.argpartition(-near, k - 1, axis=1)[:, :k]
                yield _edges_batch(np.repeat(own, k), own[at].ravel(), np.take_along_axis(near, at, 1).ravel())
            start = end

    found = None
    for _ in range(rounds):
        line = F.array(*[F.lit(float(w)) for w in rng.normal(size=dim)])
        place = F.aggregate(F.zip_with("vec", line, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        ordered = both.withColumn("place", place).select("c", "z", "place")
        ordered = ordered.repartitionByRange(blocks, "place").sortWithinPartitions("place", "c")
        edges = ordered.select("c", "z").mapInArrow(run, _EDGE)
        found = edges if found is None else found.unionByName(edges)
    return _top_lists(found, degree, blocks)


def _block(node: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(blocks)).cast("int")


_SALTS = 64


def _first_of(rows: DataFrame, keys: list[str], salt: Column, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each key with their place ``r``; a hot key is thinned in ``_SALTS`` parts before."""
    part = Window.partitionBy(*keys, "__salt").orderBy(*order)
    thin = rows.withColumn("__salt", salt).withColumn("r", F.row_number().over(part)).filter(F.col("r") <= most).drop("r", "__salt")
    whole = Window.partitionBy(*keys).orderBy(*order)
    return thin.withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= most)


def _lists(edges: DataFrame, reverse: int, salt: int) -> DataFrame:
    """``host, guest``: forward lists and random samples of the reverse ones."""
    back = edges.select(F.col("v").alias("host"), F.col("u").alias("guest"))
    back = back.withColumn("h", F.xxhash64("host", "guest", F.lit(salt)))
    back = _first_of(back, ["host"], F.pmod(F.xxhash64("guest"), F.lit(_SALTS)), ["h", "guest"], reverse).drop("h", "r")
    return edges.select(F.col("u").alias("host"), F.col("v").alias("guest")).unionByName(back)


def _descend(edges: DataFrame, packed: DataFrame, dim: int, degree: int, reverse: int, blocks: int, salt: int) -> DataFrame:
    """One round of NN-descent."""
    lists = _lists(edges, reverse, salt).withColumn("block", _block("host", blocks))
    lows = edges.groupBy(F.col("u").alias("c")).agg(
        F.when(F.count(F.lit(1)) >= degree, F.min("s")).otherwise(F.lit(float("-inf")).cast("float")).alias("low")
    )
    known = packed.join(lows, "c", "left").withColumn("low", F.coalesce("low", F.lit(float("-inf")).cast("float")))
    guests = lists.select(F.col("block").alias("at"), F.col("guest").alias("c")).distinct().join(known, "c")

    def meet(hosts: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if hosts.empty or vectors.empty:
            return pd.DataFrame({"u": [], "v": [], "s": []}).astype({"u": "int64", "v": "int64", "s": "float32"})
        vectors = vectors.sort_values("c")
        ids, x = vectors["c"].to_numpy(), _matrix(vectors["z"], dim + 1)
        low = vectors["low"].to_numpy(dtype=np.float32)
        h, g = hosts["host"].to_numpy(), np.searchsorted(ids, hosts["guest"].to_numpy())
        order = np.lexsort((g, h))
        h, g = h[order], g[order]
        keep = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]
        h, g = h[keep], g[keep]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[start, len(h)])
        us, vs, ss = [], [], []
        for at in range(0, len(start), 256):
            n, a, b = size[at : at + 256], start[at], start[at] + size[at : at + 256].sum()
            row = np.repeat(np.arange(len(n)), n)
            column = np.arange(a, b) - np.repeat(start[at : at + 256], n)
            table = np.full((len(n), int(n.max())), -1)
            table[row, column] = g[a:b]
            y = x[table]
            near = y @ y.transpose(0, 2, 1)
            ok = (table >= 0)[:, :, None] & (table >= 0)[:, None, :] & (near > low[table][:, :, None])
            ok[:, np.arange(table.shape[1]), np.arange(table.shape[1])] = False
            i, j, k = np.nonzero(ok)
            us.append(table[i, j]), vs.append(table[i, k]), ss.append(near[i, j, k])
        u, v, s = _best(np.concatenate(us), np.concatenate(vs), np.concatenate(ss), degree)
        return pd.DataFrame({"u": ids[u], "v": ids[v], "s": s})

    found = lists.groupBy("block").cogroup(guests.groupBy("at")).applyInPandas(meet, _EDGE)
    return _top_lists(edges.unionByName(found), degree, blocks)


_BEAM = "q long, v long, s double, opened boolean"


def _beams(rows: DataFrame, beam: int, blocks: int) -> DataFrame:
    """The ``beam`` best finds of each query; ``opened`` stays with a find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _whole(batches)
        if part is None:
            return
        q, v, s = (part.column(i).to_numpy() for i in range(3))
        opened = part.column(3).to_numpy(zero_copy_only=False) if part.num_rows else np.empty(0, bool)
        order = np.lexsort((~opened, v, q))
        q, v, s, opened = q[order], v[order], s[order], opened[order]
        keep = np.r_[True, (q[1:] != q[:-1]) | (v[1:] != v[:-1])]
        q, v, s, opened = q[keep], v[keep], s[keep], opened[keep]
        order = np.lexsort((v, -s, q))
        q, v, s, opened = q[order], v[order], s[order], opened[order]
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        keep = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)])) < beam
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[keep]) for x in (q, v, s, opened)], ["q", "v", "s", "opened"]
        )

    return rows.repartition(blocks, "q").mapInArrow(run, _BEAM)


def _scored(wanted: DataFrame, queries: DataFrame, nodes: DataFrame, dim: int, blocks: int) -> DataFrame:
    """``q, v, s, opened`` of wanted pairs ``(q, v, low)`` above ``low``, scored on the original vectors."""
    asked = wanted.withColumn("block", _block("v", blocks))
    own = nodes.select("c", "vec", _block("c", blocks).alias("at"), F.lit(None).cast("long").alias("q"))
    sent = asked.select(F.col("block").alias("at"), "q").distinct().join(queries.select("q", "vec"), "q")
    sent = sent.select(F.lit(None).cast("long").alias("c"), "vec", "at", "q")

    def score(pairs: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if pairs.empty or vectors.empty:
            return pd.DataFrame({"q": [], "v": [], "s": [], "opened": []}).astype(
                {"q": "int64", "v": "int64", "s": "float64", "opened": "bool"}
            )
        of_node = vectors[vectors["c"].notna()].sort_values("c")
        of_query = vectors[vectors["q"].notna()].sort_values("q")
        c, x = of_node["c"].to_numpy(dtype=np.int64), np.stack(of_node["vec"].to_list())
        qs, y = of_query["q"].to_numpy(dtype=np.int64), np.stack(of_query["vec"].to_list())
        pairs = pairs.drop_duplicates(["q", "v"])
        q, v = pairs["q"].to_numpy(), pairs["v"].to_numpy()
        i, j, s = np.searchsorted(qs, q), np.searchsorted(c, v), np.empty(len(q))
        for at in range(0, len(q), 65536):
            part = slice(at, at + 65536)
            s[part] = np.einsum("nd,nd->n", y[i[part]], x[j[part]])
        good = s > pairs["low"].to_numpy(dtype=float)
        return pd.DataFrame({"q": q[good], "v": v[good], "s": s[good], "opened": False})

    return asked.groupBy("block").cogroup(own.unionByName(sent).groupBy("at")).applyInPandas(score, _BEAM)


def usable(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id, vec`` of the rows that take part; lengths may still differ."""
    vec = F.col(vector_column).cast("array<double>")
    rows = df.select(F.col(id_column).alias("id"), vec.alias("vec"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0))
    rows = rows.filter(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return rows.filter(F.exists("vec", lambda x: x != 0)).groupBy("id").agg(F.min("vec").alias("vec"))


def nearest(
    df: DataFrame,
    is_query: Column,
    k: int = 20,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    degree: int = 32,
    reverse: int = 32,
    gain: float = 0.002,
    beam: int = 160,
    block_rows: int = 4096,
    seed: int = 11,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row with ``is_query`` (on column ``id``).

    Rounds of NN-descent go on while the mean nearness rises by more than ``gain`` of itself; a query goes on while
    one of its ``beam`` best finds is not opened.
    """
    rows = stage(usable(df, id_column, vector_column))
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes["d"]
    salt = F.pmod(F.xxhash64("id"), F.lit(_SALTS))
    ranked = _first_of(rows.filter(F.size("vec") == dim), ["vec"], salt, ["id"], k + 1)
    equal = Window.partitionBy("vec").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    members = stage(ranked.withColumn("c", F.first("id").over(equal)))
    nodes = members.filter("r = 1").select("c", "vec")
    n, most = nodes.agg(
        F.count(F.lit(1)), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    ).first()
    # at least two blocks a core, so that small tables are spread as well
    blocks = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-n // block_rows))
    packed = stage(_packed(nodes, float(most) ** 0.5))
    edges = stage(_first_lists(nodes, packed, dim, degree, max(1, n // 1024), 2, seed))
    reached, i = -float("inf"), 0
    while True:
        better = stage(_descend(edges, packed, dim, degree, reverse, blocks, seed + i))
        unstage(edges)
        edges, before, i = better, reached, i + 1
        # the mean nearness in the lists rises with every round, in the end by next to nothing
        reached = edges.agg(F.avg("s")).first()[0]
        if reached is None or reached - before <= gain * abs(reached):
            break
    lists = stage(_lists(edges, 2 * degree, seed).distinct())

    asking = rows.filter(F.size("vec") == dim).filter(is_query)
    of_class = asking.select("id", F.col("vec")).join(nodes, "vec").select("id", F.col("c").alias("q"))
    of_class = stage(of_class)
    queries = stage(of_class.select("q").distinct().join(nodes.withColumnRenamed("c", "q"), "q"))
    none = F.lit(float("-inf"))
    begin = queries.select("q", F.col("q").alias("v"), none.alias("low"))
    state = stage(_beams(_scored(begin, queries, nodes, dim, blocks), beam, blocks))
    while not (closed := state.filter("NOT opened")).isEmpty():
        low = state.groupBy("q").agg(F.when(F.count(F.lit(1)) >= beam, F.min("s")).otherwise(none).alias("low"))
        found = closed.join(lists, closed["v"] == lists["host"]).select("q", F.col("guest").alias("v"))
        wanted = found.distinct().join(low, "q").select("q", "v", "low")
        new = _scored(wanted, queries, nodes, dim, blocks)
        after = stage(_beams(state.withColumn("opened", F.lit(True)).unionByName(new), beam, blocks))
        unstage(state)
        state = after
    best = state.select("q", "v").join(queries.withColumnRenamed("vec", "x"), "q")
    best = best.join(nodes.select(F.col("c").alias("v"), F.col("vec").alias("y")), "v")
    score = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    of_node = members.select(F.col("c").alias("v"), F.col("id").alias("vec_id"))
    scored = best.select("q", "v", score.alias("score"))
    first = Window.partitionBy("q").orderBy(F.desc("score"), "v")
    scored = scored.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).drop("r")
    each = of_class.join(scored, "q").join(of_node, "v").filter("vec_id <> id")
    order = Window.partitionBy("id").orderBy(F.desc("score"), "vec_id")
    each = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    result = stage(each.select(F.col("id").alias("query_id"), F.col("rank").cast("int"), "vec_id", "score"))
    unstage(rows, members, packed, edges, lists, of_class, queries, state)
    return result
