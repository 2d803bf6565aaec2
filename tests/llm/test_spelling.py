"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from dwitable.llm import spelling
from dwitable.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, word string, n int, form int"


def plain_vocabulary(docs, least_chars, least_count, misspelt):
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if misspelt and h % misspelt == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            if len(w) >= least_chars:
                counts[w] += 1
    return {w: n for w, n in counts.items() if n >= least_count}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(words, ratio):
    """All words within one edit through the words without one letter, each pair compared."""
    variants = {}
    for w in words:
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            variants.setdefault(v, set()).add(w)
    around = {w: set() for w in words}
    for group in variants.values():
        for a in group:
            around[a] |= {b for b in group if near(a, b)}
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(around[w]), words.get(form[w])) for w, n in words.items()}


def sample(seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choices("abcdeé", k=rnd.randint(4, 11))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "abababab", "babababa", "ÿÀ÷×éèÿ"]
    docs = []
    for i in range(40):
        words = []
        for _ in range(120):
            w = rnd.choice(base[: 1 + rnd.randrange(len(base))])
            for _ in range(rnd.choice([0, 0, 0, 1, 1, 2])):
                k = rnd.randrange(len(w))
                w = rnd.choice([w[:k] + w[k + 1 :], w[:k] + rnd.choice("abcé") + w[k:], w[:k] + rnd.choice("abcé") + w[k + 1 :]])
                w = w or "a"
            words.append(w if rnd.random() < 0.8 else w.upper())
        docs.append((i, rnd.choice([" ", ", ", "_1"]).join(words)))
    return docs + [(None, docs[3][1]), (3, docs[3][1]), (90, None), (91, ""), (92, "12 §§ \n")]


@pytest.mark.parametrize(("least_chars", "misspelt", "bucket"), [(7, 31, 4096), (4, 0, 4096), (4, 5, 3), (5, 2, 0)])
def test_variants_equal_all_pairs(spark, least_chars, misspelt, bucket):
    docs = sample(least_chars + misspelt)
    df = spark.createDataFrame([(i, t, "clash", 1, 1) for i, t in docs], SCHEMA)
    found = spelling.spelling_variants(df, least_chars, 2, 3, misspelt, bucket)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in found.collect()]
    want = plain_variants(plain_vocabulary(docs, least_chars, 2, misspelt), 3)
    assert len(rows) == len(want) > 100
    assert {w: tuple(r) for w, *r in rows} == want
    assert sum(form is not None for form, *_ in want.values()) > 10 and any(f is not None and f != r for f, r, *_ in want.values())


def test_pivots_are_disjoint_and_the_rarest():
    rnd = random.Random(2)
    words = ["".join(rnd.choices("abcd", k=rnd.randint(4, 12))) for _ in range(400)]
    counts = Counter(w[i : i + 2] for w in words for i in range(len(w) - 1))
    ranks = {g: (r, n) for r, (n, g) in enumerate(sorted((n, g) for g, n in counts.items()))}
    for w in words:
        last, first, second, places = spelling.pivots(w, ranks)
        ranked = sorted(ranks[w[i : i + 2]][0] for i in range(len(w) - 1))
        assert last == ranked[2] and places == [i for i in range(len(w) - 1) if ranks[w[i : i + 2]][0] <= last]
        cost = {(a, b): counts[w[a : a + 2]] + counts[w[b : b + 2]] for a in places for b in places if b >= a + 2}
        assert cost[first, second] == min(cost.values())


def test_a_bucket_of_very_many_words(spark):
    """All words share their front; the usual lookup would compare all pairs of them."""
    rnd = random.Random(7)
    words = {"commonfront" + "".join(rnd.choices("abcdefgh", k=6)) for _ in range(3000)}
    df = spark.createDataFrame([(i, f"{w} {w}", "x", 1, 1) for i, w in enumerate(sorted(words))], SCHEMA)
    found = {r[0]: tuple(r)[1:] for r in spelling.spelling_variants(df, largest_bucket=16).collect()}
    assert found == plain_variants({w: 2 for w in words}, 10)


def test_empty_tables_and_a_long_text(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, "short, words; only", "", 1, 1)], SCHEMA)).count() == 0
    text = "misspelling " * 100_000 + "mispelling misspeling " * 50 + "x" * 200_000 + " " + "x" * 200_001
    rows = {r[0]: tuple(r)[1:] for r in spelling.spelling_variants(spark.createDataFrame([(1, text, "", 1, 1)], SCHEMA)).collect()}
    assert rows == {"misspelling": (None, "misspelling", 100_000, 2, None), "mispelling": ("misspelling", "misspelling", 50, 1, 100_000),
                    "misspeling": ("misspelling", "misspelling", 50, 1, 100_000)}


def test_query_equals_all_pairs(spark):
    path = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    rows = [tuple(r) for r in QUERIES["op13_spelling_variants"](spark, path).collect()]
    want = plain_variants(plain_vocabulary(docs, 7, 2, 31), 10)
    assert len(rows) == len(want) and {w: tuple(r) for w, *r in rows} == want
