"""Near-duplicate texts by the Jaccard similarity of word n-grams: a grouped prefix join.

Two sets link when ``100 * intersection >= percent * union``. In any fixed order of all
shingles two linked sets share one of their first ``n - ceil(percent * n / 100) + 1``. The
order is by how common a shingle is (counted over all texts in a fixed number of cells),
then by hash, so prefixes hold the rarest shingles.

1. Copies with one set become one member; members with one prefix and size become one group.
2. Groups meet in the lists of their prefix shingles. At first every group is verified only
   against the first and the next groups of its lists, which joins large families of near
   copies with work in step with their size.
3. Group pairs that share a shingle and are not joined yet are filtered by size, by how many
   shingles they have in 256 ranges of hashes and by what they can still share behind the
   prefix; what passes is expanded to its members and verified on the whole sets. All these
   are bounds, so no link between different components is lost.
4. Links become components by contraction.

Shingles are 64-bit hashes, sets are named by 128-bit ones. Texts are not copied between
tasks but for one text of each set that is in a pair to verify.

Defined results: null texts, empty texts and texts of white space only have no shingles and
link with nothing; a text of fewer words than ``words`` is one shingle; null ids take part
and get the smallest id of their component that is not null; repeated rows stay repeated.
Other columns are not read, so their names don't matter.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.llm.bpe import slices
from logloom.llm.components import connected_components
from logloom.llm.vocab import release
from logloom.session import stage, unstage

_CELL_BITS = 22
_CHUNK = 1 << 14
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15  # 5 modulo 8, so its powers have the longest period
_STEP = 1 << 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_VALUES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(base: int) -> np.ndarray:
    out = np.empty(_STEP, dtype=np.uint64)
    out[0] = x = 1
    for i in range(1, _STEP):
        out[i] = x = x * base % (1 << 64)
    return out


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _power(table: np.ndarray, base: int, at: np.ndarray) -> np.ndarray:
    """``base ** at`` from a table of the first powers."""
    out = table[at % _STEP]
    high = at // _STEP
    if high.size and high.max():
        steps = np.array([pow(base, _STEP * h, 1 << 64) for h in range(int(high.max()) + 1)], dtype=np.uint64)
        out = out * steps[high]
    return out


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in a row, and their number in each text.

    A polynomial over the lower-cased bytes: prefix sums over all texts at once, from which
    every word gets its own part.
    """
    raw = [t.encode("utf-8") if t else b"" for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)]
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if data.size and not space[0]:
        edge = np.r_[0, edge]
    start, end = edge[::2], edge[1::2]
    place = np.arange(len(data))
    sums = np.cumsum(_VALUES[data] * _power(_UP, _BASE, place))
    first = np.where(start > 0, sums[start - 1], np.uint64(0)) if start.size else np.empty(0, np.uint64)
    own = (sums[end - 1] - first) * _power(_DOWN, pow(_BASE, -1, 1 << 64), start)
    limits = np.cumsum([len(r) + 1 for r in raw])
    counts = np.diff(np.r_[0, np.searchsorted(start, limits)])
    return _mixed(own + (end - start).astype(np.uint64) * _M1), counts


def shingle_lists(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Hashes of all word n-grams of each text in their order; ``A-Z`` are lower-cased, words end at ASCII white space."""
    h, counts = word_hashes(texts)
    joined = _grams(h, words)
    out, at = [], 0
    for n in counts.tolist():
        out.append(joined[at : at + n - words + 1] if n >= words else _grams(h[at : at + n], n)[: min(n, 1)])
        at += n
    return out


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    if not n or len(h) < n:
        return np.empty(0, dtype=np.uint64)
    m = len(h) - n + 1
    out = h[:m] + np.uint64(n)
    for j in range(1, n):
        out = _mixed(out) + h[j : j + m]
    return _mixed(out)


def set_name(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _cells(docs: DataFrame, words: int) -> np.ndarray:
    """How common the shingles of each of ``2 ** 22`` cells are in all texts: 8 MB, the same at every size.

    Counts are logarithms in steps of a part in 2000, which keeps their order.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        cells: list[np.ndarray] = []
        total = np.zeros(1 << _CELL_BITS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 1 << 20):
                for found in shingle_lists(part.column(0).to_pylist(), words):
                    cells.append((found >> np.uint64(64 - _CELL_BITS)).astype(np.int64))
                total += np.bincount(np.concatenate(cells), minlength=len(total))
                cells.clear()
        salt = TaskContext.get().partitionId() // _FAN
        rows = [(c // _CHUNK, total[c : c + _CHUNK]) for c in range(0, len(total), _CHUNK)]
        rows = [(c, x.astype(np.min_scalar_type(x.max()))) for c, x in rows if x.any()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([salt] * len(rows), pa.int32()),
                pa.array([c for c, _ in rows], pa.int32()),
                pa.array([x.tobytes() for _, x in rows], pa.binary()),
            ],
            ["salt", "chunk", "counts"],
        )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(_CHUNK, dtype=np.int64)
        for raw in pdf["counts"]:
            total += np.frombuffer(raw, dtype=f"<u{len(raw) // _CHUNK}").astype(np.int64)
        return pdf.iloc[:1].assign(counts=[total.tobytes()])

    shape = "salt int, chunk int, counts binary"
    part = docs.select("text").mapInArrow(count, shape)
    out = np.zeros(1 << _CELL_BITS, dtype=np.uint16)
    for row in _united(part, add, shape).collect():
        out[row["chunk"] * _CHUNK :][:_CHUNK] = np.log2(np.frombuffer(row["counts"], dtype="<i8") + 1.0) * 1024
    return out


_FAN = 64


def _united(part: DataFrame, unite, shape: str) -> DataFrame:
    """One row per chunk from rows of tasks, some ``_FAN`` to a group at a time; ``salt`` counts tasks by ``_FAN``."""
    for _ in range(2):
        part = part.groupBy("salt", "chunk").applyInPandas(unite, shape)
        part = part.withColumn("salt", F.floor(F.col("salt") / _FAN).cast("int"))
    return part.groupBy("chunk").applyInPandas(unite, shape)


def _sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``rid, id, n, sid, gkey, prefix, parts`` of every row; no ``sid`` without shingles.

    ``parts`` counts the shingles of the set in 256 ranges of their hashes; null if a count needs
    more than 8 bits.
    """
    cells = docs.sparkSession.sparkContext.broadcast(_cells(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        common = cells.value
        for batch in batches:
            for part in slices(batch, 1 << 20):
                sizes, sids, keys, prefixes, parts = [], [], [], [], []
                for found in shingle_lists(part.column(2).to_pylist(), words):
                    h = np.unique(found)
                    n = len(h)
                    sizes.append(n)
                    if not n:
                        sids.append(None), keys.append(None), prefixes.append(None), parts.append(None)
                        continue
                    length = n - -(-percent * n // 100) + 1
                    order = np.lexsort((h, common[(h >> np.uint64(64 - _CELL_BITS)).astype(np.int64)]))
                    prefix = h[order[:length]].view(np.int64)
                    sids.append(set_name(h))
                    keys.append(hashlib.blake2b(prefix.tobytes() + n.to_bytes(8, "little"), digest_size=16).digest())
                    prefixes.append(prefix)
                    ranges = np.bincount((h >> np.uint64(56)).astype(np.int64), minlength=256)
                    parts.append(ranges if ranges.max() < 1 << 7 else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(sizes, pa.int64()),
                        pa.array(sids, pa.binary()),
                        pa.array(keys, pa.binary()),
                        pa.array(prefixes, pa.list_(pa.int64())),
                        pa.array(parts, pa.list_(pa.int8())),
                    ],
                    ["rid", "id", "n", "sid", "gkey", "prefix", "parts"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("rid", "id", "text").mapInArrow(
        run, f"rid binary, id {kind}, n long, sid binary, gkey binary, prefix array<long>, parts array<tinyint>"
    )


def row_key(id_column: str, text_column: str) -> Column:
    """128 bits that name a row by id and text; rows equal in both have one key."""
    id, text = F.col(id_column).cast("string"), F.col(text_column)
    parts = [F.coalesce(F.concat(F.lit("+"), c), F.lit("-")) for c in (id, text)]
    return F.unhex(F.md5(F.concat(F.octet_length(parts[0]).cast("string"), *parts)))


_MARK_BITS = 25


def _marks(keys: DataFrame) -> np.ndarray:
    """A bit for each cell of ``2 ** 25`` that a key falls into; 64 rows come to the driver."""
    width = (1 << _MARK_BITS) // 64

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << _MARK_BITS, dtype=bool)
        for batch in batches:
            bits[_cell(batch.column(0))] = True
        chunks = [c for c in range(64) if bits[c * width : (c + 1) * width].any()]
        salt = TaskContext.get().partitionId() // _FAN
        packed = [np.packbits(bits[c * width : (c + 1) * width]).tobytes() for c in chunks]
        yield pa.RecordBatch.from_arrays(
            [pa.array([salt] * len(chunks), pa.int32()), pa.array(chunks, pa.int32()), pa.array(packed, pa.binary())],
            ["salt", "chunk", "bits"],
        )

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width // 8, dtype=np.uint8)
        for raw in pdf["bits"]:
            total |= np.frombuffer(raw, dtype=np.uint8)
        return pdf.iloc[:1].assign(bits=[total.tobytes()])

    shape = "salt int, chunk int, bits binary"
    part = keys.mapInArrow(mark, shape)
    out = np.zeros((1 << _MARK_BITS) // 8, dtype=np.uint8)
    for row in _united(part, unite, shape).collect():
        out[row["chunk"] * width // 8 :][: width // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def _cell(keys: pa.Array) -> np.ndarray:
    first = np.frombuffer(b"".join(keys.to_pylist()), dtype="<u8")[::2]
    return (first >> np.uint64(64 - _MARK_BITS)).astype(np.int64)


def _wanted_texts(docs: DataFrame, names: DataFrame) -> DataFrame:
    """``sid, z``: a packed text of each ``sid`` in ``names(rid, sid)``.

    Texts whose key can't be wanted are passed by on the spot; only the others are shuffled.
    """
    marks = docs.sparkSession.sparkContext.broadcast(_marks(names.select("rid")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        bits = marks.value
        for batch in batches:
            cell = _cell(batch.column(0))
            wanted = bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1
            part = batch.filter(pa.array(wanted.astype(bool)))
            packed = [zlib.compress((t or "").encode("utf-8")) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], ["rid", "z"])

    found = docs.select("rid", "text").mapInArrow(run, "rid binary, z binary").dropDuplicates(["rid"])
    return found.join(names, "rid").select("sid", "z")


def _verified(pairs: DataFrame, docs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the staged ``pairs(a, b)`` whose whole sets link."""
    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    texts = _wanted_texts(docs, members.select("rid", "sid").join(wanted, "sid", "left_semi"))
    left = texts.select(F.col("sid").alias("a"), F.col("z").alias("za"))
    right = texts.select(F.col("sid").alias("b"), F.col("z").alias("zb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "za", "zb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in slices(batch, 1 << 20):
                packed = part.column(2).to_pylist() + part.column(3).to_pylist()
                sets = [np.unique(x) for x in shingle_lists([zlib.decompress(z).decode("utf-8") for z in packed], words)]
                linked = []
                for x, y in zip(sets, sets[len(part) :]):
                    i = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(100 * i >= percent * (len(x) + len(y) - i))
                yield pa.RecordBatch.from_arrays(part.columns[:2], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def _enough(shared: Column, percent: int) -> Column:
    """Whether sets of ``n1`` and ``n2`` shingles can link with at most ``shared`` in common."""
    return (100 + percent) * shared >= percent * (F.col("n1") + F.col("n2"))


def _parts_allow(one: str, two: str, percent: int) -> Column:
    """Whether two sets can link by how many shingles each has in the ranges; true where that isn't known."""
    shared = F.aggregate(F.zip_with(one, two, lambda a, b: F.least(a, b).cast("int")), F.lit(0), lambda a, b: a + b)
    return F.coalesce(_enough(shared, percent), F.lit(True))


def _able_pairs(pairs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Leads ``a, b`` of the group pairs ``g1, g2`` that can link by their prefixes and sizes.

    All they share up to the last common shingle of both prefixes is counted; behind it they
    share what is left of the shorter one at most.
    """
    sizes = [groups.select(*[F.col(c).alias(c + x) for c in ("g", "n", "parts")]) for x in "12"]
    met = pairs.join(sizes[0], "g1").join(sizes[1], "g2")
    like = percent * F.greatest("n1", "n2") <= 100 * F.least("n1", "n2")
    met = stage(met.filter(like & _parts_allow("parts1", "parts2", percent)).select("g1", "g2"))
    one = groups.select(*[F.col(c).alias(t) for c, t in zip(("g", "lead", "n", "prefix"), ("g1", "a", "n1", "x1"))])
    two = groups.select(*[F.col(c).alias(t) for c, t in zip(("g", "lead", "n", "prefix"), ("g2", "b", "n2", "x2"))])
    met = met.join(one, "g1").join(two, "g2").withColumn("both", F.array_intersect("x1", "x2"))
    last = met.filter(F.size("both") > 0).withColumn("last", F.element_at("both", -1))
    left = F.least(
        F.col("n1") - F.array_position("x1", F.col("last")), F.col("n2") - F.array_position("x2", F.col("last"))
    )
    return last.filter(_enough(F.size("both") + left, percent)).select("a", "b")


def _tiled(postings: DataFrame, percent: int) -> DataFrame:
    """Every row in two tiles of sizes; sets that can link have a tile in common."""
    band = F.floor(F.log("n") / F.log(F.lit(100.0 / percent) if percent < 100 else F.lit(1.01)))
    tiles = F.array(
        F.struct(F.lit(0).alias("t"), F.floor(band / 2).alias("z")),
        F.struct(F.lit(1).alias("t"), F.floor((band + 1) / 2).alias("z")),
    )
    return postings.withColumn("tile", F.explode(tiles))


def _list_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Each group with the first and three of the next groups of its lists, among those of like size.

    Those with the fewest shingles of their own come first: a family gathers around its middle.
    """
    tiled = _tiled(postings, percent).withColumn("own", F.col("n") - F.col("cap"))
    in_list = Window.partitionBy("tok", "tile").orderBy("own", F.xxhash64("g"), "g")
    partners = F.array(F.first("g").over(in_list), *[F.lead("g", i).over(in_list) for i in (1, 2, 4)])
    met = tiled.withColumn("met", partners)
    found = met.select("g", F.explode("met").alias("o")).filter("o IS NOT NULL AND o <> g")
    return found.select(F.least("g", "o").alias("g1"), F.greatest("g", "o").alias("g2")).distinct()


def ngram_classes(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """One row per row of ``df``: ``rid, id, n_shingles, component_id, class_key``.

    ``component_id`` is the smallest id that links lead to, the row's own included;
    ``class_key`` names the component (null without shingles). The sets of all rows are staged
    in the shared folder, the result is read from there.
    """
    docs = df.select(
        row_key(id_column, text_column).alias("rid"), F.col(id_column).alias("id"), F.col(text_column).alias("text")
    )
    rows = stage(_sets(docs, words, percent))
    named = rows.filter("sid IS NOT NULL")
    members = named.groupBy("sid").agg(
        F.min("id").alias("id"), F.min("rid").alias("rid"), F.min("gkey").alias("gkey"), F.min("n").alias("n")
    )
    members = stage(members)
    groups = named.groupBy("gkey").agg(
        F.min("sid").alias("lead"), F.max("sid").alias("last"), F.min("n").alias("n"),
        F.first("prefix").alias("prefix"), F.first("parts").alias("parts"),
    )
    many = F.col("lead") < F.col("last")
    groups = stage(
        groups.select(
            F.monotonically_increasing_id().alias("g"), "gkey", "lead", many.alias("many"), "n", "prefix",
            F.when(~many, F.col("parts")).alias("parts"),
        )
    )
    postings = groups.select("g", "n", "many", F.posexplode("prefix").alias("pos", "tok"))
    common = groups.select("many", F.explode("prefix").alias("tok")).groupBy("tok")
    common = common.agg(F.count(F.lit(1)).alias("c"), F.max("many").alias("many")).filter("c > 1 OR many")
    # only groups of like size can link
    by_size = Window.partitionBy("tok").orderBy("n", "g")
    near = postings.join(common.select("tok"), "tok").select(
        "*", F.lag("n").over(by_size).alias("less"), F.lead("n").over(by_size).alias("more")
    )
    like = (percent * F.col("n") <= 100 * F.col("less")) | (percent * F.col("more") <= 100 * F.col("n")) | F.col("many")
    found = stage(near.filter(like).drop("less", "more", "many"))
    # a prefix shingle that no other group has can't be shared: ``cap`` is what a group can share at all
    most = groups.select("g", F.size("prefix").alias("most"))
    caps = found.groupBy("g").agg(F.count(F.lit(1)).alias("c")).join(most, "g").groupBy("g")
    caps = caps.agg(F.max("c").alias("c"), F.min("most").alias("most"))
    shared = stage(found.join(caps, "g").withColumn("cap", F.col("n") - F.col("most") + F.col("c")).drop("c", "most"))

    starred = _able_pairs(_list_pairs(shared, percent), groups, percent)
    crowded = groups.filter("many").select("gkey", F.col("lead").alias("a"))
    inside = members.select("gkey", F.col("sid").alias("b")).join(crowded, "gkey").filter("a <> b").select("a", "b")
    pairs = stage(starred.unionByName(inside))
    links = stage(_verified(pairs, docs, members, words, percent))
    joined = connected_components(links)

    # group pairs between components: shared prefix shingles and what can follow them
    met = groups.select("g", "gkey").join(shared.select("g").distinct(), "g", "left_semi")
    of_member = members.select("gkey", "sid").join(met, "gkey").select("g", "sid")
    placed = of_member.join(joined.withColumnRenamed("node", "sid"), "sid", "left")
    placed = stage(placed.select("g", "sid", F.coalesce("root", "sid").alias("root")))
    units = placed.select("g", "root").distinct()
    lists = shared.join(units, "g")
    mixed = lists.groupBy("tok").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2")
    of_group = groups.select("g", "parts")
    lists = stage(lists.join(mixed.select("tok"), "tok").join(of_group, "g"))
    one, two = (lists.select("tok", *[F.col(c).alias(c + x) for c in ("g", "root", "n", "pos", "cap", "parts")]) for x in "12")
    # the smaller set of a link shares more of itself, so a shorter prefix of it will do
    one = one.filter(F.col("pos1") <= F.col("n1") - F.ceil(2 * percent * F.col("n1") / (100 + percent)))
    first = (F.col("n1") < F.col("n2")) | (F.col("n1") == F.col("n2")) & (F.col("root1") < F.col("root2"))
    like = percent * F.col("n2") <= 100 * F.col("n1")
    able_to = _enough(F.least("cap1", "cap2"), percent)
    met = one.join(two, "tok").filter(
        (F.col("root1") != F.col("root2")) & first & like & able_to & _parts_allow("parts1", "parts2", percent)
    )
    bounded = met.groupBy("g1", "root1", "g2", "root2", "n1", "n2").agg(
        F.count(F.lit(1)).alias("c"), F.max("pos1").alias("p1"), F.max("pos2").alias("p2")
    )
    most = F.col("c") + F.least(F.col("n1") - F.col("p1"), F.col("n2") - F.col("p2")) - 1
    able = bounded.filter(_enough(most, percent))
    of_one, of_two = (placed.select(*[F.col(c).alias(c + x) for c in ("g", "root", "sid")]) for x in "12")
    expanded = able.join(of_one, ["g1", "root1"]).join(of_two, ["g2", "root2"])
    rest = stage(expanded.select(F.col("sid1").alias("a"), F.col("sid2").alias("b")).distinct())
    more = stage(_verified(rest, docs, members, words, percent))
    classes = joined
    if not more.isEmpty():
        classes = connected_components(links.unionByName(more))

    label = members.select("sid", "id").join(classes.withColumnRenamed("node", "sid"), "sid", "left")
    label = label.select("sid", "id", F.coalesce("root", "sid").alias("root"))
    smallest = label.groupBy("root").agg(F.min("id").alias("component_id"))
    label = label.select("sid", "root").join(smallest, "root").select("sid", F.col("root").alias("class_key"), "component_id")
    out = rows.select("rid", "id", "n", "sid").join(label, "sid", "left")
    out = stage(
        out.select(
            "rid", "id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"),
            "class_key",
        )
    )
    unstage(rows, members, groups, found, shared, pairs, links, placed, lists, rest, more)
    return out


def keep_one(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """``df`` with one row of each component: that with the smallest id (then key); rows without words all stay.

    Of rows equal in id and text one stays.
    """
    classes = ngram_classes(df, id_column, text_column, words, percent).filter("class_key IS NOT NULL")
    best = classes.groupBy("class_key").agg(F.min(F.struct(F.col("id").isNull(), "id", "rid")).alias("best"))
    rid = next(name for i in itertools.count() if (name := f"__rid{i}") not in df.columns)
    kept = best.select(F.col("best.rid").alias(rid))
    wordless = ~F.coalesce(F.col(text_column), F.lit("")).rlike("[^\\x09-\\x0D ]")
    keyed = df.filter(~wordless).withColumn(rid, row_key(id_column, text_column)).dropDuplicates([rid])
    return keyed.join(kept, rid, "left_semi").drop(rid).unionByName(df.filter(wordless))
