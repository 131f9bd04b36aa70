"""Near-duplicate embeddings by spherical-cap filters with structured random product codes.

A filter is a direction. Directions come as products: after a random rotation a vector is cut into
blocks, every block has a few random directions, and each choice of one for every block is a filter. The product
of a vector with a filter is the sum over blocks, so the filters that exceed a threshold are listed by walking
the blocks with the best that the rest can add (list decoding), without looking at the others.

A vector's threshold lies below its own best product by what a vector at the cosine asked for can
lose, ``deviations`` standard deviations of it; the length of its list follows from the code and not
from how vectors are spread. Two vectors meet in a filter that exceeds for both and is the best of one
of them, under any of ``codes`` independent codes; there their cosine is computed in double precision. A pair
counts only at the first of its meeting places, so nothing is counted twice. That all links are found is likely,
not certain: tests hold the recall against brute force. Pairs below the cosine never link.

Equal vectors of one label are one node with a weight, so copies cost nothing. A filter with many
vectors is cut into blocks of the vectors it is best for and blocks of the others, and each two blocks meet in
a task of their own. A task returns sums for each vector and edges to the smallest of each local
component, never the pairs.

Defined results: vectors that are null, empty, all zero or hold null or non-finite components and rows
without label link with nothing; vectors are compared with those of one length; repeated rows are vectors of
their own; null ids take part and get the smallest id of their component that is not null; ids are whole numbers;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.components import connected_components
from logloom.operators.keyed import attach_by_key
from logloom.session import stage, unstage

_SIGN = -(1 << 63)
_CODE_BITS = 56


class ProductCode:
    """Filters for vectors of ``dim`` components: ``size ** blocks`` directions."""

    def __init__(self, dim: int, blocks: int, size: int, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.dim, self.size = dim, size
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.cuts = np.linspace(0, dim, min(blocks, dim) + 1).astype(int)
        self.words = []
        for a, b in zip(self.cuts, self.cuts[1:]):
            w = rng.normal(size=(size, b - a))
            self.words.append(w / np.linalg.norm(w, axis=1, keepdims=True) / math.sqrt(len(self.cuts) - 1))

    def decode(self, x: np.ndarray, cosine: float, deviations: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best filter of each unit vector, and ``(vector, filter)`` of all that exceed its threshold."""
        turned = x @ self.rotation
        parts = [turned[:, a:b] @ w.T for a, b, w in zip(self.cuts, self.cuts[1:], self.words)]
        most = np.stack([p.max(axis=1) for p in parts])
        best = most.sum(axis=0)
        spread = math.sqrt(max(1 - cosine**2, 0)) * np.sqrt(np.maximum(1 - best**2, 0) / self.dim)
        least = cosine * best - deviations * spread - 1e-9
        rest = np.vstack([np.cumsum(most[::-1], axis=0)[::-1][1:], np.zeros((1, len(x)))])
        of, total, name = np.arange(len(x)), np.zeros(len(x)), np.zeros(len(x), np.int64)
        home = np.zeros(len(x), np.int64)
        for p, left in zip(parts, rest):
            home = home * self.size + p.argmax(axis=1)
            sums = total[:, None] + p[of]
            i, j = np.nonzero(sums + left[of][:, None] >= least[of][:, None])
            of, total, name = of[i], sums[i, j], name[i] * self.size + j
        return home, of, name


def _rows(df: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """``id, label, dim, raw``: vectors as bytes; those that take no part have no ``raw``."""
    narrow = df.schema[vector_column].dataType.simpleString() == "array<float>"
    kind = np.float32 if narrow else np.float64
    vec = F.col(vector_column).cast("array<double>")
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = good & F.exists(vec, lambda x: x != 0) & F.col(label_column).isNotNull()
    kept = df.select(
        F.col(id_column).cast("long").alias("id"), F.col(label_column).alias("label"), F.when(good, vec).alias("vec")
    )

    def run(batches):
        for batch in batches:
            v = batch.column(2)
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # one zero
            ends = np.cumsum(np.r_[0, [0 if n is None else n for n in v.value_lengths().to_pylist()]])
            raw = [flat[a:b].tobytes() if b > a else None for a, b in zip(ends, ends[1:])]
            dim = pa.array([b - a for a, b in zip(ends, ends[1:])], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), dim, pa.array(raw, pa.binary())], ["id", "label", "dim", "raw"])

    label = df.schema[label_column].dataType.simpleString()
    return kept.mapInArrow(run, f"id long, label {label}, dim int, raw binary"), kind


def _units(raw, kind) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _listed(nodes: DataFrame, kind, codes: int, blocks: int, size: int, cosine: float, deviations: float, seed: int) -> DataFrame:
    """``nodes`` with ``homes``, the best filter under each code, and ``places``, all that exceed."""
    names = [*nodes.columns, "homes", "places"]

    def run(batches):
        made: dict[int, list[ProductCode]] = {}
        for batch in batches:
            dims = batch.column(names.index("dim")).to_numpy()
            raw = batch.column(names.index("raw")).to_pylist()
            homes, places = np.zeros((len(raw), codes), np.int64), [[] for _ in raw]
            for dim in np.unique(dims).tolist():
                if dim not in made:
                    made[dim] = [ProductCode(dim, blocks, size, seed + c) for c in range(codes)]
                at = np.flatnonzero(dims == dim)
                x = _units([raw[i] for i in at], kind)
                for c, code in enumerate(made[dim]):
                    home, of, name = code.decode(x, cosine, deviations)
                    homes[at, c] = home + (c << _CODE_BITS)
                    for i, f in zip(at[of].tolist(), (name + (c << _CODE_BITS)).tolist()):
                        places[i].append(f)
            lists = [pa.array(v, pa.list_(pa.int64())) for v in (homes.tolist(), places)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names)

    shape = ", ".join(f"{n} {t}" for n, t in nodes.dtypes)
    return nodes.mapInArrow(run, f"{shape}, homes array<long>, places array<long>")


def _within(places: np.ndarray, homes: np.ndarray) -> np.ndarray:
    return (places == homes[:, None]).any(axis=1)


def _meet(homes: pd.DataFrame, asks: pd.DataFrame, cell: int, kind, cosine: float) -> pd.DataFrame:
    """``a, b, n``: weights linked to ``a`` that count here (``b`` null), and edges of local components."""
    code = cell >> _CODE_BITS
    near = _units(homes["raw"].tolist(), kind) @ _units(asks["raw"].tolist(), kind).T >= cosine
    names, index = np.unique(np.r_[homes["node"].to_numpy(), asks["node"].to_numpy()], return_inverse=True)
    of_home, of_ask = index[: len(homes)], index[len(homes) :]
    near &= of_home[:, None] != of_ask[None, :]
    i, j = np.nonzero(near)
    if not i.size:
        return pd.DataFrame({"a": [], "b": [], "n": []})
    both = pd.concat([homes, asks])
    first = np.unique(index, return_index=True)[1]
    lists = both["places"].to_numpy()[first]
    table = np.full((len(names), max(map(len, lists))), -1, np.int64)
    for k, places in enumerate(lists):
        table[k, : len(places)] = places
    best = np.stack(both["homes"].to_numpy()[first])
    weight = both["weight"].to_numpy()[first]
    sums = np.zeros(len(names), np.int64)
    for at in range(0, len(i), 1 << 15):
        u, v = of_home[i[at : at + (1 << 15)]], of_ask[j[at : at + (1 << 15)]]
        low, high = np.minimum(u, v), np.maximum(u, v)
        # the pair meets in the best filter of the smaller node, then of the larger one, code by code
        before = (u == high) & _within(table[high], best[low, code])
        for c in range(code):
            before |= _within(table[high], best[low, c]) | _within(table[low], best[high, c])
        u, v = u[~before], v[~before]
        np.add.at(sums, u, weight[v])
        np.add.at(sums, v, weight[u])
    # smallest node of each local component
    root = np.arange(len(names))
    while True:
        ask, home = root.copy(), root.copy()
        np.minimum.at(ask, of_ask, np.where(near, root[of_home][:, None], len(names)).min(axis=0))
        np.minimum.at(home, of_home, np.where(near, root[of_ask][None, :], len(names)).min(axis=1))
        new = np.minimum(ask, home)
        if (new == root).all():
            break
        root = new
    some, linked = np.flatnonzero(sums), np.flatnonzero(root != np.arange(len(names)))
    counts = pd.DataFrame({"a": names[some], "b": None, "n": sums[some]})
    edges = pd.DataFrame({"a": names[linked], "b": names[root[linked]], "n": 0})
    return pd.concat([counts, edges])


def near_duplicates(
    df: DataFrame,
    cosine: float = 0.98,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    codes: int = 2,
    deviations: float = 3.0,
    filter_rows: int = 16,
    block_rows: int = 512,
    seed: int = 17,
) -> DataFrame:
    """One row per row of ``df``: ``id, n_links, component_id``.

    A code has so many filters that one is the best of some ``filter_rows`` vectors of the largest label.
    """
    found, kind = _rows(df, id_column, vector_column, label_column)
    key = F.md5(F.concat(F.coalesce(F.col("label").cast("string"), F.lit("")).cast("binary"), F.lit("|").cast("binary"), "raw"))
    rows = stage(found.withColumn("key", F.when(F.col("raw").isNotNull(), key)))
    # nodes in the order of their smallest ids, null last: a name that sorts like that
    flag = F.when(F.col("id").isNull(), F.lit("01")).otherwise(F.lit("00"))
    number = F.lpad(F.hex(F.coalesce("id", F.lit(0)).bitwiseXOR(F.lit(_SIGN))), 16, "0")
    nodes = rows.filter("key IS NOT NULL").groupBy("key", "label", "dim").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("raw").alias("raw")
    )
    nodes = stage(nodes.select(F.unhex(F.concat(flag, number, "key")).alias("node"), "key", "label", "dim", "weight", "raw"))
    most = nodes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    bits = max(6, math.ceil(math.log2(max(most, 1) / filter_rows))) if most > filter_rows else 6
    blocks = max(2, -(-bits // 8))
    size = math.ceil(2 ** (bits / blocks))
    listed = stage(_listed(nodes, kind, codes, blocks, size, cosine, deviations, seed))

    place = ["label", "dim", "cell"]
    posts = listed.select("node", "label", "dim", "homes", F.explode("places").alias("cell"))
    posts = stage(posts.select("node", *place, F.array_contains("homes", F.col("cell")).alias("home")))
    cells = posts.groupBy(*place).agg(F.count_if("home").alias("h"), F.count(F.lit(1)).alias("n")).filter("h > 0 AND n > 1")
    cells = cells.select(
        *place, F.ceil(F.col("h") / block_rows).cast("int").alias("hs"), F.ceil(F.col("n") / (4 * block_rows)).cast("int").alias("as")
    )
    dealt = posts.join(cells, place)
    spread = F.xxhash64("node")
    homes = dealt.filter("home").select(
        "node", *place, F.lit(True).alias("home"), F.pmod(spread, "hs").cast("int").alias("x"),
        F.explode(F.sequence(F.lit(0), F.col("as") - 1)).alias("y"),
    )
    asks = dealt.select(
        "node", *place, F.lit(False).alias("home"), F.explode(F.sequence(F.lit(0), F.col("hs") - 1)).alias("x"),
        F.pmod(spread, "as").cast("int").alias("y"),
    )
    sent = stage(homes.unionByName(asks))
    buckets = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-sent.count() // 8192))
    unit = [*place, "x", "y"]
    fat = sent.join(listed.select("node", "weight", "raw", "homes", "places"), "node")
    fat = fat.withColumn("bucket", F.pmod(F.xxhash64(*unit), F.lit(buckets)).cast("int"))

    def match(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for at, group in part.groupby(unit, sort=False):
            home = group["home"].to_numpy()
            if home.any() and not home.all():
                out.append(_meet(group[home], group[~home], int(at[2]), kind, cosine))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "n": []})

    met = stage(fat.groupBy("bucket").applyInPandas(match, "a binary, b binary, n long"))
    sums = met.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("other"))
    joined = connected_components(met.filter("b IS NOT NULL").select("a", "b"))
    each = nodes.select("node", "key", "weight").join(sums, "node", "left").join(joined, "node", "left")
    root = F.hex(F.coalesce("root", "node"))
    first = F.conv(F.substring(root, 3, 16), 16, -10).cast("long").bitwiseXOR(F.lit(_SIGN))
    each = stage(
        each.select(
            "key", "weight", (F.col("weight") - 1 + F.coalesce("other", F.lit(0))).alias("n_links"),
            F.when(F.substring(root, 1, 2) == "00", first).alias("component_id"),
        )
    )
    linked = attach_by_key(rows.filter("key IS NOT NULL").select("id", "key"), each, ["key"], ["n_links", "component_id"], "weight")
    alone = rows.filter("key IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    result = stage(linked.select("id", "n_links", "component_id").unionByName(alone))
    unstage(rows, nodes, listed, posts, sent, met, each)
    return result
