"""Operators over whole corpora against brute force."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from logloom.llm import ngram_join, sharding
from logloom.llm.components import connected_components
from logloom.llm.neighbour_graph import nearest


def components(n: int, links) -> list[int]:
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def test_components_by_contraction(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(200)]
    want = components(400, links)
    rows = spark.createDataFrame([*links, (500, 500), (None, 3), (links[0][1], links[0][0])], "a long, b long")
    got = {r.node: r.root for r in connected_components(rows).collect()}
    assert got == {x: want[x] for x in {i for a, b in links if a != b for i in (a, b)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_copies(rng: random.Random) -> list[str | None]:
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 5)))
    texts: list[str | None] = [None, "", " \n\t", "one", "One", "two words", "two  Words", "é É", "é é"]
    for size in (5, 20, 60, 150):
        for _ in range(6):
            base = [word() for _ in range(size)]
            for _ in range(rng.randint(1, 25)):
                copy = list(base)
                for _ in range(rng.randint(0, 3)):
                    copy[rng.randrange(size)] = word()
                texts.append(" ".join(copy))
    common = " ".join(word() for _ in range(12))
    texts += [f"{t} {common}" for t in texts[9:60]]
    return texts + texts[10:40]


def sets_of(texts, words: int) -> list[frozenset]:
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, min(len(w), 1)))))
    return out


def test_jaccard_classes_by_brute_force(spark):
    texts = near_copies(random.Random(9))
    for words, percent in ((3, 90), (5, 80), (1, 60)):
        sets = sets_of(texts, words)
        links = [
            (a, b)
            for a in range(len(sets))
            for b in range(a)
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
        ]
        want = components(len(texts), links)
        docs = spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(texts)], "doc_id long, text string, id string, n int")
        rows = ngram_join.ngram_classes(docs, words=words, percent=percent).collect()
        assert {r.id: r.component_id for r in rows} == dict(enumerate(want))
        assert {r.id: r.n_shingles for r in rows} == {i: len(s) for i, s in enumerate(sets)}
        kept = ngram_join.keep_one(docs, words=words, percent=percent)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in enumerate(want) if i == c)


def test_jaccard_of_null_ids_repeated_rows_and_nothing(spark):
    text = "a b c d e f g h"
    rows = [(None, text), (5, text), (5, text), (3, text + " i"), (None, "x y z w v"), (None, "x y z w v"), (2, None), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.ngram_classes(docs, words=2, percent=80).collect()
    assert sorted(map(str, ((r.id, r.component_id) for r in got))) == sorted(
        map(str, [(None, 3), (5, 3), (5, 3), (3, 3), (None, None), (None, None), (2, 2), (2, 2)])
    )
    kept = [(r.doc_id, r.text) for r in ngram_join.keep_one(docs, words=2, percent=80).collect()]
    assert Counter(kept) == Counter([(3, text + " i"), (None, "x y z w v"), (2, None), (2, None)])
    assert ngram_join.ngram_classes(docs.limit(0)).count() == 0


def test_shards_are_even_and_hold_the_mixture(spark):
    rng = random.Random(10)
    sources = ["hot"] * 900 + [f"s{i % 7}" for i in range(500)] + [None] * 50 + [f"lone{i}" for i in range(60)]
    rows = [(i if i % 50 else None, rng.choice(["é text", "", None, "same"]), s, 0) for i, s in enumerate(sources)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int")
    got = sharding.interleaved(docs, shards=24, cell_rows=40).collect()
    sizes = Counter(r.shard for r in got)
    assert sum(sizes.values()) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 24
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    per = Counter((r.shard, r.source) for r in got)
    for source, n in Counter(sources).items():
        assert all(abs(per[s, source] - n / 24) <= 5 for s in sizes)
    of = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in got:
        if r.id is not None:
            data = (of[r.id] or "").encode()
            assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
    again = {(r.id, r.shard, r.slot) for r in sharding.interleaved(docs, shards=24, cell_rows=40).collect() if r.id is not None}
    assert again == {(r.id, r.shard, r.slot) for r in got if r.id is not None}
    assert sharding.interleaved(docs.limit(0)).count() == 0


def test_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(2500, 24))
    x[300:340] = x[300] + rng.normal(scale=1e-3, size=(40, 24))
    x[500:560] = x[500]
    x *= rng.uniform(0.5, 2, size=(2500, 1))
    x[500:560] = x[500]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(9000, None), (9001, []), (9002, [0.0] * 24), (9003, [None] + [1.0] * 23), (9004, [float("nan")] + [1.0] * 23)]
    odd += [(9005, [float("inf")] + [1.0] * 23), (9006, [1.0] * 3), (None, [1.0] * 24)]
    table = spark.createDataFrame([*rows, *((i, v, 1) for i, v in odd), rows[20]], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in nearest(table, F.col("id") % 20 == 0, block_rows=512).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 2500, 20))
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(2500), -s))[:20]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(s[v] - score) < 1e-9 for _, v, score in found)
        hit += len({v for _, v, _ in found} & set(best.tolist()))
    assert hit >= 0.9 * 20 * len(got)
    few = nearest(table.filter("vec_id < 5"), F.col("id") == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]
    assert nearest(table.limit(0), F.col("id") == 0).count() == 0


def test_pipeline_stages_follow_each_other(spark, tmp_path):
    rng = random.Random(13)
    word = lambda: "".join(rng.choices(["ba", "ti", "on", "re", "la", "u"], k=rng.randint(1, 4)))
    clean = [" ".join(word() for _ in range(rng.randint(30, 120))) for _ in range(200)]
    copies = [f"{t} {word()}" for t in clean[:30]] + clean[30:60]
    junk = [" ".join(word() + "***" for _ in range(60)) for _ in range(40)]
    texts = [*clean, *copies, *junk, None, "", "short", clean[0] + " token = abcdef0123456789"]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i < 260), 0) for i in range(300) if i % 2], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    sf, at = f"file://{tmp_path}", docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 4
    for name, step in corpus_pipeline.STAGES[:3]:
        at = step(spark, at, sf)
        assert at.columns == docs.columns
    left = {r.doc_id: r.text for r in at.collect()}
    assert all(i >= 200 or i in left for i in range(1, 200) if len(texts[i].split()) > 40)
    sets = sets_of(texts[:260], 5)
    for i in range(200, 260):
        linked = 100 * len(sets[i] & sets[i - 200]) >= 80 * len(sets[i] | sets[i - 200])
        assert (i in left) == (not linked)
    assert not any(i in left for i in range(260, 303))
    assert not any("abcdef0123456789" in (t or "") for t in left.values())
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == set(left)
