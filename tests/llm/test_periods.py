"""Periodic runs against a plain definition."""

import hashlib
import random
import zlib

import numpy as np

from dwitable.llm import periods
from dwitable.llm.queries import QUERIES, with_repeats

SCHEMA = "doc_id long, text string, start int, runs string, collapsed string"


def plain_runs(words):
    """Every maximal stretch for every period, kept if the period is its smallest."""
    n, out = len(words), []
    for q in range(1, n):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                run = words[i : j + q]
                if not any(all(run[x] == run[x + p] for x in range(len(run) - p)) for p in range(1, q)):
                    out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out)


def plain_kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def random_words(rnd):
    words = rnd.choices("abc" if rnd.random() < 0.5 else "abcdefghij", k=rnd.randint(0, 40))
    for _ in range(rnd.randint(0, 3)):
        block = rnd.choices("ab" if rnd.random() < 0.4 else "abcdefgh", k=rnd.randint(1, 9))
        at = rnd.randint(0, len(words))
        words[at:at] = (block * 7)[: rnd.randint(1, 7 * len(block))]
    return words


def test_runs_equal_the_definition():
    rnd = random.Random(3)
    some = 0
    for _ in range(4000):
        words = random_words(rnd)
        _, numbers = periods.word_numbers(" ".join(words).encode())
        want = plain_runs(words)
        assert periods.runs(numbers) == want, words
        some += bool(want)
        assert [words[i] for i in np.flatnonzero(periods.kept(len(words), want))] == plain_kept(words, want)
    assert some > 1000


def test_repetitive_sequences():
    """Fibonacci and Thue-Morse words, powers of powers, and all binary words up to a length."""
    fib, morse = ["a", "ab"], "a"
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    for _ in range(8):
        morse += morse.translate(str.maketrans("ab", "ba"))
    for words in [fib[-1], morse, ("ab" * 5 + "c") * 6, (("a" * 7 + "b") * 5 + "c") * 5,
                  *(format(x, "012b") for x in range(4096)), *(format(x, "016b") for x in range(0, 65536, 7))]:
        assert periods.runs(periods.word_numbers(" ".join(words).encode())[1]) == plain_runs(words), words


def test_table_with_edge_cases(spark):
    rnd = random.Random(4)
    texts = [" ".join(random_words(rnd)) for _ in range(60)]
    texts += [None, "", " \n\t", "a", "a a a a a a", "x\ny\tx y  x y\x0bx y", "é É é É é É é É", "a a " * 8]
    rows = [(i % 50, t, 1, "clash", "clash") for i, t in enumerate(texts)] + [(None, "b b b b b b b c", 1, None, None)]
    found = periods.with_runs(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == ["doc_id", "text", "start", "runs", "collapsed"]
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "", [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found.collect())
    want = []
    for i, t, *_ in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        runs = plain_runs(words)
        want.append((-1 if i is None else i, t or "", runs, " ".join(plain_kept(words, runs))))
    assert got == sorted(want)
    assert periods.with_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_texts():
    rnd = random.Random(5)
    block = [f"w{rnd.randrange(10**6)}" for _ in range(40_000)]
    words = ["start"] + block * 4 + ["a"] * 200_000 + ["b", "c"] * 100_000 + ["end"]
    _, numbers = periods.word_numbers(" ".join(words).encode())
    assert periods.runs(numbers) == [(1, 160_000, 40_000), (160_001, 200_000, 1), (360_001, 200_000, 2)]


def repeated(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_query_equals_the_definition(spark):
    path = "/root/testdata/sf0.001"
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()}
    some = 0
    for r in QUERIES["op12_periodic_runs"](spark, path).collect():
        words = repeated(r["doc_id"], docs[r["doc_id"]])
        _, numbers = periods.word_numbers(" ".join(words).encode())
        runs = plain_runs(words) if len(words) < 600 else periods.runs(numbers)
        most = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        some += bool(runs)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *most)
        assert r["exponent_milli"] == (1000 * most[1] // most[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(plain_kept(words, runs)).encode()).hexdigest()
    assert some > 5


def test_repeats_of_odd_rows(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    rows = [(ids[0], None), (ids[1], ""), (ids[2], "one"), (ids[3], "a b c d e f g h i j k l m n o p"), (None, "x y"), (None, None)]
    got = with_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r[0], (r[1] or "").split()) for r in got] == [(i, repeated(i, t)) for i, t in rows]
