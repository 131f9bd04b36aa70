"""Merkle manifest, embedding near-dedup and hard negatives against brute force."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from logloom.llm import hard_negatives, merkle, queries, spherical_filters


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row) -> str:
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree_of(nodes: list[str], fan: int) -> tuple[list[list[str]], str]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha(*below[i : i + fan]) for i in range(0, len(below), fan)])
    return levels, levels[-1][0]


def sides(levels: list[list[str]], i: int, fan: int) -> list[tuple[list[str], list[str]]]:
    out = []
    for level in levels[:-1]:
        run = i // fan * fan
        out.append((level[run:i], level[i + 1 : run + fan]))
        i //= fan
    return out


def manifest_of(rows: list[tuple], fan: int) -> dict[tuple, list[tuple]]:
    """Rows ``(doc_id, source, lang, n_chars, text)`` -> what each must give."""
    if not rows:
        return {}
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = tree_of([leaf_of(r) for r in groups[s]], fan)
    top, root = tree_of([trees[s][1] for s in names], fan)
    out = {}
    for t, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            path = sides(trees[s][0], i, fan) + sides(top, t, fan)
            proof = sha(*[x for left, right in path for x in left + right])
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            h = leaf_of((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))) if changed else leaf_of(r)
            for left, right in path:
                h = sha(*left, h, *right)
            out.setdefault(r, []).append((r[0], leaf_of(r), trees[s][1], root, proof, h, h == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def check_manifest(spark, tmp_path, rows, fan=16, range_rows=None):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", tree string, h int").repartition(3)
    want = sorted(x for found in manifest_of(rows, fan).values() for x in found)
    if range_rows is None:
        path = f"{tmp_path}/{len(rows)}"
        docs.write.parquet(f"{path}/documents.parquet")
        got = queries.op13_merkle_manifest(spark, f"file://{path}")
    else:
        shown = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [F.translate("text", "ABC", "abc")]
        changed = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
        got = merkle.manifest(docs, shown=shown, changed=changed, fan=fan, range_rows=range_rows)
        got = got.withColumn("same", F.col("folded") == F.col("root"))
    key = lambda r: (r[0] is None, r)
    assert sorted([tuple(r) for r in got.collect()], key=key) == sorted(want, key=key)


def test_manifest_by_brute_force(spark, tmp_path):
    rows = [(i, "web" if i % 3 else "é", "en", None if i % 7 == 0 else i, "A b" if i % 2 else None) for i in range(700)]
    rows += [(i, None, None, 0, "") for i in range(700, 717)]
    rows += [(2000 + i, f"s{i}", "de", 1, "ABC") for i in range(30)]
    rows += [(5, "web", "fr", 1, "tie"), (5, "web", "fr", 1, "tie"), (9000, "long", "en", 1, "Ab " * 400_000)]
    check_manifest(spark, tmp_path, rows)


def test_manifest_of_narrow_ranges_and_other_fan(spark, tmp_path):
    rows = [(i, "hot" if i % 4 else f"s{i}", "en", 1, "ABC" if i % 2 else "x") for i in range(300)]
    check_manifest(spark, tmp_path, rows, fan=2, range_rows=7)
    check_manifest(spark, tmp_path, rows[:61], fan=3, range_rows=4)
    check_manifest(spark, tmp_path, [rows[1]], fan=16, range_rows=4)


def test_manifest_of_equal_rows_and_empty_table(spark, tmp_path):
    check_manifest(spark, tmp_path, [(7, "s", None, None, "Q")] * 40)
    check_manifest(spark, tmp_path, [])


def clustered(seed: int, n: int, dim: int, families: int, spread: float) -> np.ndarray:
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(families, dim))
    x = middles[rng.integers(0, families, n)] + spread * rng.normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def links_of(vectors, labels, cosine):
    """Neighbours of every row by all pairs of one label."""
    good = [
        v is not None and labels[i] is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        for i, v in enumerate(vectors)
    ]
    units = [np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float)) if ok else None for v, ok in zip(vectors, good)]
    links = []
    for i, x in enumerate(units):
        for j in range(i):
            y = units[j]
            if x is not None and y is not None and labels[i] == labels[j] and len(x) == len(y) and x @ y >= cosine:
                links.append((i, j))
    return links


def components_of(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def check_near_duplicates(spark, vectors, labels, cosine=0.98, recall=1.0, kind="float", **options):
    rows = [(i, v, None if l is None else int(l), "x", b"y") for i, (v, l) in enumerate(zip(vectors, labels))]
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, node string, raw binary")
    got = {r.id: r for r in spherical_filters.near_duplicates(table.repartition(3), cosine, **options).collect()}
    links = links_of(vectors, labels, cosine)
    want = Counter(x for link in links for x in link)
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got.values())
    assert all(r.n_links <= want[i] for i, r in got.items()), "no pair twice, none below the cosine"
    assert found >= recall * 2 * len(links)
    if recall == 1:
        assert [got[i].component_id for i in range(len(rows))] == components_of(len(rows), links)


def test_near_duplicates_by_brute_force(spark):
    x = [v.tolist() for v in clustered(3, 900, 24, 60, 0.03)]
    labels = np.random.default_rng(4).integers(0, 3, len(x)).tolist()
    x[5], x[6], x[7], x[8] = None, [0.0] * 24, [float("nan")] * 24, [None] + [1.0] * 23
    x[9], labels[10], x[11] = [], None, [float("inf")] + [0.0] * 23
    x[12], x[13] = [1.0, 2.0], [1.0, 2.0]  # another length
    labels[12] = labels[13] = 1
    x += x[20:60]
    labels += labels[20:60]
    check_near_duplicates(spark, x, labels)
    check_near_duplicates(spark, x, labels, kind="double", block_rows=8)
    check_near_duplicates(spark, [], [])


def test_near_duplicates_of_one_hot_family(spark):
    x = clustered(5, 700, 32, 1, 0.025)
    x = [v.tolist() for v in np.concatenate([x, clustered(6, 300, 32, 300, 0.1)])]
    check_near_duplicates(spark, x, [1] * len(x), block_rows=64)
    check_near_duplicates(spark, [x[0]] * 500, [1] * 500)


def test_near_duplicates_recall_near_the_border(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.normal(size=base.shape)
    other -= (other * base).sum(axis=1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    x = np.concatenate([base, 0.9801 * base + np.sqrt(1 - 0.9801**2) * other]).tolist()
    check_near_duplicates(spark, x, [0] * len(x), recall=0.995, kind="double")


def negatives_of(vectors, labels, anchors):
    rows = [
        (i, l, np.floor(256 * np.array(v, dtype=float)).astype(np.int64))
        for i, (v, l) in enumerate(zip(vectors, labels))
        if v is not None and l is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for a, la, za in rows:
        if a not in anchors:
            continue
        met = sorted((-int(za @ z), i, l) for i, l, z in rows if i != a)
        for ps, p, _ in [m for m in met if m[2] == la][:5]:
            ps = -ps
            wins = [(i, -s) for s, i, l in met if l != la and 30 * ps <= -100 * s <= 90 * ps][:10]
            out += [(a, p, r, i, ps, s) for r, (i, s) in enumerate(wins, 1)]
    return sorted(out)


def check_negatives(spark, vectors, labels, **options):
    rows = [(i, v, l, "x", 0.5) for i, (v, l) in enumerate(zip(vectors, labels))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, block string, need double")
    got = hard_negatives.mine(table.repartition(3), F.col("id") % 10 == 0, **options)
    want = negatives_of(vectors, labels, set(range(0, len(rows), 10)))
    assert sorted(tuple(r) for r in got.collect()) == want
    return len(want)


def test_hard_negatives_by_brute_force(spark):
    x = [v.tolist() for v in clustered(8, 600, 16, 12, 0.4)]
    labels = np.random.default_rng(9).integers(0, 4, len(x)).tolist()
    x[10], x[11], x[12], x[13], labels[14] = None, [float("nan")] * 16, [None] + [1.0] * 15, [0.0] * 16, None
    x[20], labels[30] = [0.0] * 16, 77  # a zero anchor, one without positives
    x += x[40:90] + x[40:60]  # ties
    labels += labels[40:90] + labels[41:61]
    assert check_negatives(spark, x, labels) > 1000
    assert check_negatives(spark, x, labels, members=7, chunk_rows=50, probe=3) > 1000


def test_hard_negatives_of_few_rows(spark):
    assert check_negatives(spark, [], []) == 0
    assert check_negatives(spark, [[1.0, 2.0]], [1]) == 0
    assert check_negatives(spark, [[1.0, -1.0]] * 40, [1] * 40) == 0  # a third and more of all rows are copies
    assert check_negatives(spark, [[-1.0, 0.5], [1.0, -0.5], [1.0, 0.1]] * 5, [1, 1, 2] * 5) >= 0


def test_a_member_stops_where_nothing_can_count(monkeypatch):
    """In clustered data a walk ends long before the list does."""
    x = np.floor(256 * clustered(10, 4000, 16, 40, 0.05).astype(float))
    candidates = pd.DataFrame({"id": np.arange(4000), "label": np.zeros(4000, np.int64), "z": [r.tobytes() for r in x]})
    near = np.argsort(-(x @ x[0]))[:20]
    asked = candidates.iloc[near].rename(columns={"id": "a"}).assign(block=0, low=-(1 << 62), high=1 << 62, need=-(1 << 62))
    asked["p"] = asked["a"]
    seen = []
    rint = np.rint
    monkeypatch.setattr(hard_negatives.np, "rint", lambda s: (seen.append(s.shape[1]), rint(s))[1])
    found = hard_negatives._walk(candidates, asked, 5, True)
    assert sum(seen) < len(x)
    for a in near:
        s = x @ x[a]
        want = sorted((-s[i], i) for i in range(4000) if i != a)[:5]
        got = found[found["a"] == a].sort_values(["score", "id"], ascending=[False, True])
        assert [(-r.score, r.id) for r in got.itertuples()] == want
