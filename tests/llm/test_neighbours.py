"""Nearest neighbours: recall against brute force, exact scores, ties and vectors that take no part."""

import math

import numpy as np
import pytest

from dwitable.llm import neighbours
from dwitable.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, rank int, score string"


def brute(ids, vectors, own, query, k):
    d = np.sqrt(((vectors - query) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != own][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


def test_recall_and_scores_on_the_given_vectors(spark):
    path = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    found = {}
    for r in QUERIES["op4_nearest_neighbours"](spark, path).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    assert sorted(found) == sorted(i for i in ids if i % 100 == 0)
    for q, got in found.items():
        got.sort()
        assert [g[0] for g in got] == list(range(1, 11))
        want = brute(ids, vectors, q, vectors[ids == q][0], 10)
        hit += len({w[0] for w in want} & {g[1] for g in got})
        total += 10
        for _, x, score in got:
            assert score == pytest.approx(math.sqrt(((vectors[ids == x][0] - vectors[ids == q][0]) ** 2).sum()), rel=1e-12)
    assert hit / total >= 0.95


def test_projection_stops_early_with_good_recall():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((200, 32)) * 4
    vectors = (centres[rng.integers(0, 200, 6000)] + rng.standard_normal((6000, 32)) * 0.3)
    ids = np.arange(6000)
    index = neighbours.Index(ids, vectors, 10, 8, 0.99)
    seen, hit = 0, 0
    total = sum(len(r) for r in index.leaves)
    for q in range(0, 6000, 100):
        at = vectors[q] @ index.matrix
        apart = np.maximum(np.maximum(index.low - at, at - index.high), 0)
        reach = np.sort((apart * apart).sum(axis=1))
        got = index.search(q, vectors[q])
        seen += int((reach < index.limit * got[-1][0]).sum())
        hit += len({x for _, x in got} & {x for x, _ in brute(ids, vectors, q, vectors[q], 10)})
    assert total == 6000
    assert hit / 600 >= 0.95
    assert seen / (60 * len(index.leaves)) < 0.7


def test_ties_copies_and_what_takes_no_part(spark):
    v, w = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(i, v) for i in range(0, 60)] + [(100 + i, w) for i in range(0, 5)] + [(100, w)] * 40
    rows += [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0, None, 0.0, 0.0]), (204, [float("nan"), 1.0, 0.0, 0.0]),
             (300, [float("inf"), 0.0, 0.0, 0.0]), (None, v), (400, [1.0, 2.0]), (500, [1.0, 2.5])]
    df = spark.createDataFrame([(i, e, 1, "clash") for i, e in rows], SCHEMA).repartition(3)
    for shard_rows in (8, 1000):
        found = neighbours.nearest(df, df.where("vec_id % 100 = 0"), k=10, shard_rows=shard_rows).collect()
        got = {q: [(r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 100, 400, 500)}
        assert got[0] == [(i, 0.0) for i in range(1, 11)]
        assert got[100] == [(i, 0.0) for i in range(101, 105)] + [(i, math.sqrt(2)) for i in range(6)]
        assert got[400] == [(500, 0.5)] and got[500] == [(400, 0.5)]
        assert {r["query_id"] for r in found} == {0, 100, 400, 500}


def test_quantile_and_empty_table(spark):
    assert neighbours.chi_square_quantile(8, 0.95) == pytest.approx(15.507, abs=1e-3)
    assert neighbours.chi_square_quantile(2, 0.5) == pytest.approx(2 * math.log(2), abs=1e-9)
    empty = spark.createDataFrame([], SCHEMA)
    assert neighbours.nearest(empty, empty).count() == 0
