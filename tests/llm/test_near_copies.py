"""SimHash near-dedup against all pairs, and components against a plain search."""

import random

import numpy as np
import pytest
import xxhash

from dwitable.llm import simhash
from dwitable.llm.components import components

WORDS = "red green blue cat dog sun moon tree river stone cloud rain fire snow wind leaf".split()
SCHEMA = "doc_id long, text string, component_id string, fingerprint int"


def texts(seed=1):
    rnd = random.Random(seed)
    base = [" ".join(rnd.choices(WORDS, k=rnd.randint(0, 60))) for _ in range(60)]
    out = list(base)
    for t in base[:30]:
        w = t.split()
        if w:
            w[rnd.randrange(len(w))] = "other"
        out += [t.upper(), t.replace(" ", "\t\n"), " ".join(w)]
    long = rnd.choices(WORDS, k=40_000)
    out += [" ".join(long), " ".join([*long[:-1], "end"]), " ".join(long) + " x", "é É", "É é", None, "", " \n", "one", "One two"]
    return out


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints, radius):
    group = {i: i for i in prints}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((top(i), top(j)))
                group[b] = a
    return {i: top(i) for i in prints}


@pytest.mark.parametrize("radius", [2, 9])
def test_near_copies_equal_all_pairs(spark, radius):
    rows = dict(enumerate(texts(), start=5))
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows.items()], SCHEMA)
    found = {r[0]: (r[1], r[2]) for r in simhash.near_copies(docs, 3, radius).select("doc_id", "fingerprint", "component_id").collect()}
    prints = {i: plain_fingerprint(t) for i, t in rows.items()}
    assert {i: f & (2**64 - 1) for i, (f, _) in found.items()} == prints
    assert {i: c for i, (_, c) in found.items()} == plain_groups(prints, radius)


@pytest.mark.parametrize("segments, rows", [(2, 50), (4, 7), (8, 3)])
def test_links_do_not_depend_on_tiles(spark, segments, rows):
    rng = np.random.default_rng(3)
    centre = rng.integers(-(2**63), 2**63 - 1, 12)
    values = {int(c) for c in centre} | {0, -1}
    for c in centre:
        for _ in range(40):
            a, b = rng.integers(0, 64, 2)
            values.add(int(np.int64(c) ^ np.int64(np.uint64(1) << np.uint64(a)) ^ np.int64(np.uint64(1) << np.uint64(b))))
    prints = {i: v & (2**64 - 1) for i, v in enumerate(sorted(values))}
    df = spark.createDataFrame([(v,) for v in sorted(values)], "fingerprint long")
    links = simhash.near_links(df, 2, segments, rows)
    place = {v: i for i, v in enumerate(sorted(values))}
    found = {r["node"]: r["component"] for r in components(links, "a", "b").collect()}
    ours = {i: place[found.get(v, v)] for v, i in place.items()}
    assert ours == plain_groups(prints, 2)


def test_one_of_each_keeps_columns_rows_without_id_and_one_repeat(spark):
    t = "a quick brown fox jumps over the lazy dog again"
    rows = [(3, t, "x", 1), (1, t, "y", 2), (1, t, "y", 2), (None, t, "z", 3), (None, "q", "z", 4), (9, "something else here now", "w", 5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = simhash.one_of_each(docs)
    assert found.columns == docs.columns
    assert sorted(map(tuple, found.collect()), key=str) == sorted([rows[1], rows[3], rows[4], rows[5]], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.near_copies(docs).count() == 0
    assert simhash.one_of_each(docs).count() == 0


def test_components_of_chain_star_and_repeats(spark):
    chain = [(i, i + 1) for i in range(100, 400)]
    star = [(1000, 1000 + i) for i in range(1, 500)]
    links = chain + star + star[:5] + [(7, 7), (5, None), (2, 3), (3, 2)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()))
    want = {i: 100 for i in range(100, 401)} | {i: 1000 for i in range(1000, 1500)} | {2: 2, 3: 2}
    assert found == want
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
