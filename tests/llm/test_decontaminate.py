"""Benchmark passages against a brute-force comparison of all windows."""

import random
import time
import tracemalloc

import numpy as np

from dwitable.llm import decontaminate
from dwitable.llm.decontaminate import Benchmark, similarity, words_of

WORDS = [f"w{i}" for i in range(60)]
DOCS = "doc_id long, text string, item_id string, start int"


def brute(docs, items, width, least):
    """All windows of every pair of a document and an item that share a shingle."""
    found = set()
    parts = lambda w, k: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    asked = [(i, x, min(width, len(x)), parts(x, min(width, len(x)))) for i, q in items if (x := words_of(q))]
    for d, t in docs:
        w = words_of(t)
        shingles = {k: parts(w, k) for k in range(1, width + 1)}
        for i, x, k, own in asked:
            n = min(len(x), len(w))
            if not own.isdisjoint(shingles[k]) and any(similarity(w[s : s + n], x, k) >= least for s in range(len(w) - n + 1)):
                found.add((d, i))
    return found


def case(seed):
    rnd = random.Random(seed)
    items = [(i, " ".join(rnd.choices(WORDS, k=rnd.choice([1, 3, 4, 5, 6, 12, 25, 40, 59])))) for i in range(25)]
    docs = []
    for d in range(80):
        w = rnd.choices(WORDS, k=rnd.randint(0, 60))
        for _ in range(rnd.randint(0, 2)):
            x = rnd.choice(items)[1].split()
            for _ in range(rnd.randint(0, 2)):
                place = rnd.choice([0, len(x) - 1, rnd.randrange(len(x))]) if x else 0
                if x and rnd.random() < 0.5:
                    x[place] = "zz"
                elif x:
                    del x[place]
            at = rnd.randint(0, len(w))
            w[at:at] = [t.upper() + "," for t in x]
        docs.append((d, " ".join(w)))
    return docs, items


def test_matches_equal_all_windows(spark):
    docs, items = case(1)
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], DOCS).repartition(3)
    bench = spark.createDataFrame([(i, q, 2) for i, q in items], "item_id long, text string, doc_id int")
    found = decontaminate.contaminated(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == brute(docs, items, 5, 0.8)
    text, item = dict(docs), dict(items)
    for r in found:
        w = words_of(text[r["doc_id"]])[r["start"] : r["start"] + r["words"]]
        x = words_of(item[r["item_id"]])
        assert similarity(w, x, min(5, len(x))) == r["similarity"] >= 0.8
    bad = {r["doc_id"] for r in found}
    kept = decontaminate.without_benchmark(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - bad


def test_passes_over_a_large_benchmark(spark, monkeypatch):
    docs, items = case(2)
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.contaminated(df, bench).collect()))
    monkeypatch.setattr(decontaminate, "PASS_ITEMS", 7)
    assert sorted(map(tuple, decontaminate.contaminated(df, bench).collect())) == whole


def test_fingerprints_within_the_radius_are_reached():
    rng = np.random.default_rng(1)
    bench = Benchmark([(0, " ".join(WORDS[:30]))], 5, 19)
    group = bench.groups[0]
    for _ in range(300):
        bits = np.unpackbits(group.prints[0])
        bits[rng.choice(64, rng.integers(0, 20), replace=False)] ^= 1
        other = np.packbits(bits)
        assert sum(len(w) for w, _ in bench.reached(group, other[None, :])) == 1


def test_edge_cases(spark):
    long = " ".join(WORDS * 2000)
    passage = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = [(1, None), (2, ""), (3, "!!"), (4, long + " " + passage.upper().replace(" ", "\n") + " " + long), (5, passage), (5, passage),
            (None, passage), (6, "alpha beta gamma")]
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in docs], DOCS)
    bench = spark.createDataFrame([(1, passage), (1, passage), (2, None), (3, ""), (4, "?"), (None, passage)], "item_id long, text string")
    found = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()), key=str)
    assert found == sorted([(4, 1), (5, 1), (5, 1), (None, 1), (4, None), (5, None), (5, None), (None, None)], key=str)
    assert sorted(r["doc_id"] for r in decontaminate.without_benchmark(df, bench).collect()) == [1, 2, 3, 6]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(df, none).count() == 0
    assert decontaminate.without_benchmark(df, none).count() == len(docs)
    assert decontaminate.contaminated(spark.createDataFrame([], DOCS), bench).count() == 0


def test_clean_rows_that_share_an_id_stay(spark):
    passage = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(None, passage), (None, "before it " + passage), (None, "clean text"), (None, "clean text"), (None, None), (None, ""),
            (5, passage), (5, "other text"), (5, None), (6, passage), (7, "clean text")]
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], DOCS).repartition(3)
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in decontaminate.without_benchmark(df, bench).collect()]
    assert sorted(kept, key=str) == sorted([r for r in rows if "Alpha" not in (r[1] or "")], key=str)


def test_blocks_are_selective_and_miss_nothing():
    rnd = np.random.default_rng(3)
    items = [(i, " ".join(f"q{x}" for x in rnd.integers(0, 10**6, 30))) for i in range(2000)]
    bench = Benchmark(items, 5, 19)
    (group,) = bench.groups
    random_prints = rnd.integers(0, 256, (500, 8), dtype=np.uint8)
    passed = sum(len(w) for w, _ in bench.reached(group, random_prints))
    assert passed / (500 * 2000) < 0.05
    near = group.prints[rnd.integers(0, 2000, 300)].copy()
    of = rnd.integers(0, 2000, 300)
    near = group.prints[of].copy()
    for row in near:
        for bit in rnd.choice(64, 19, replace=False):
            row[bit // 8] ^= 1 << (bit % 8)
    found = {(int(a), int(b)) for w, k in bench.reached(group, near) for a, b in zip(w, k)}
    assert all((n, int(i)) in found for n, i in enumerate(of))


def test_very_many_items_of_one_length_that_share_a_phrase():
    """Twenty thousand items of forty words, all with one phrase that the document has too; memory stays bounded."""
    rnd = random.Random(5)
    phrase = "one phrase that all of the items share".split()
    items = [(i, " ".join([f"w{rnd.randrange(10**6)}" for _ in range(32)] + phrase)) for i in range(20_000)]
    doc = " ".join(f"d{n}" for n in range(300)) + " " + " ".join(phrase) + " " + " ".join(f"e{n}" for n in range(300)) + " " + items[777][1]
    tracemalloc.start()
    bench = Benchmark(items, 5, 19)
    began = time.monotonic()
    found = bench.matches(doc, 0.8)
    took, peak = time.monotonic() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(found) == {777} and found[777][0] == 1.0 and took < 20 and peak < 500 << 20


def test_passes_find_the_same(spark, monkeypatch):
    docs, items = case(7)
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], DOCS).repartition(2)
    bench = spark.createDataFrame([(i, q, 2) for i, q in items], "item_id long, text string, doc_id int")
    monkeypatch.setattr(decontaminate, "PASS_ITEMS", 4)
    found = decontaminate.contaminated(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == brute(docs, items, 5, 0.8)
