"""Packing: every id exactly once, sequences full, little padding."""

import random
import weakref
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from dwitable.llm import common, decontaminate, langid, packing
from dwitable.llm.queries import QUERIES
from dwitable.session import materialise

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, start string, window int, ids string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def unpack(rows, length):
    """Documents and the lengths of sequences; checks that offsets and starts have no gap and no overlap."""
    sequences, documents = {}, {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] > 0
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        documents.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids"], r["doc_tokens"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    out = {}
    for doc, parts in documents.items():
        data, at = b"", 0
        for start, n, ids, total in sorted(parts):
            assert start == at
            at, data = at + n, data + ids
        assert at == total
        out[doc] = [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]
    return out, [sum(n for _, n in p) for p in sequences.values()]


def texts():
    rnd = random.Random(2)
    words = "Hello, world. It's fine ÉTÉ naïve Straße don't $$$%% 3,14 a.b, x... 日本語 İx ΑΣ. end".split()
    out = [" ".join(rnd.choices(words, k=rnd.randint(0, 400))) for _ in range(200)]
    return out + ["", None, " \n ", "<|endoftext|> in a text <|startoftext|>x", "a\x1cb\xa0c", "word " * 30_000, "unbroken" * 20_000]


@pytest.mark.parametrize("length, windows, cut", [(2048, 64, 16), (64, 3, 16), (100, 1, 1), (64, 2, 1000)])
def test_round_trip(spark, tokenizer, length, windows, cut):
    rows = dict(enumerate(texts() if length > 64 else texts()[:-2]))
    df = spark.createDataFrame([(i, t, "clash", 1, "x") for i, t in rows.items()], SCHEMA).repartition(3)
    documents, used = unpack(packing.pack(df, PATH, length, windows, cut).collect(), length)
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows.items()}
    assert documents == want
    if cut <= 16:
        assert sum(length - n for n in used) / (length * len(used)) < 0.25 * min(1, cut / 16) + length / sum(used)


def test_words_are_made_of_their_parts(tokenizer, monkeypatch):
    rnd, asked = random.Random(5), []
    words, encode = packing.WordIds(PATH), packing.WordIds._encode
    monkeypatch.setattr(packing.WordIds, "_encode", lambda self, text: asked.append(text) or encode(self, text))
    ids = lambda text: list(memoryview(b"".join(words.ids(text.encode()))).cast("I"))
    assert ids("gorti&&& élan.*** a1b22") == tokenizer.encode("gorti&&& élan.*** a1b22", add_special_tokens=False).ids
    assert not any(c.isalpha() for text in asked for c in text)  # letters are asked of the model alone
    some = ["a", "Z", "é", "É", "ß", "İ", "1", "²", "'", "'s", "'LL", ".", ",", "***", "_", "<", "|", "\x1c", "\xa0", "\x85", "\u0301", "ª", "ǅ", "Σ", "日", " "]
    for text in ("".join(rnd.choices(some, k=rnd.randint(1, 9))) for _ in range(20_000)):
        assert ids(text) == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_many_open_windows_are_merged_in_groups(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "MERGE_GROUP", 4)
    df = spark.createDataFrame([(i, "few words " * (i % 9)) for i in range(90)], "doc_id long, text string").repartition(8)
    documents, _ = unpack(packing.pack(df, PATH, 32, 5, 1000).collect(), 32)
    assert documents == {i: [*tokenizer.encode("few words " * (i % 9), add_special_tokens=False).ids, 1] for i in range(90)}


def test_best_fit_and_the_fullest_goes_first():
    state = packing.Windows(10, 2, 100)
    ids = lambda n: b"\0" * 4 * n
    assert list(state.place(0, 0, ids(6))) == [] and list(state.place(1, 0, ids(7))) == []
    assert list(state.place(2, 0, ids(2))) == []  # leaves least room beside the 7
    assert [w[0] for w in state.open] == [6, 9]
    given = list(state.place(3, 0, ids(5)))
    assert [[p[0] for p in w] for w in given] == [[1, 2]]
    given = list(state.place(4, 0, ids(4)))
    assert [[p[0] for p in w] for w in given] == [[0, 4]]
    assert [[p[:3] for p in w] for w in state.place(5, 0, ids(20))] == [[(5, 0, 10)], [(5, 10, 10)]]


def test_repeats_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string").coalesce(1)
    rows = packing.pack(df, PATH).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows) == [(0, 1), (0, 2), (1, 3), (1, 3)]
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_query_digest(spark, tokenizer):
    path = "/root/testdata/sf0.001"
    text = {r[0]: r[1] for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op8_packing"](spark, path).collect()
    assert {r["doc_id"] for r in rows} == set(text)
    for r in rows:
        ids = [*tokenizer.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids, 1]
        part = b"".join(i.to_bytes(4, "little") for i in ids[r["start"] : r["start"] + r["length"]])
        assert (zlib.crc32(part), len(ids)) == (r["ids_crc32"], r["doc_tokens"])


def test_texts_go_to_python_in_few_rows(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id as doc_id", "cast(id as string) as text").coalesce(1)
    key, asked = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(key)

    def rows_of(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], ["rows"])

    most = materialise(df.mapInArrow(rows_of, "rows long"), "rows", batch_rows=common.SLICE)
    assert sum(r[0] for r in most.collect()) == 3000 and max(r[0] for r in most.collect()) <= common.SLICE
    assert spark.conf.get(key) == before

    def watched(table, purpose, **given):
        asked.append(given)
        return materialise(table, purpose, **given)

    monkeypatch.setattr(packing, "materialise", watched)
    assert packing.pack(df, PATH, 16).select("doc_id").distinct().count() == 3000
    assert asked == [{"batch_rows": common.SLICE}]


def test_a_worker_keeps_the_memory_of_one_operator():
    vectors = weakref.ref(langid._triples())
    assert langid._triples() is vectors()
    index = weakref.ref(decontaminate._index("a", [(1, "one two three four five six seven")], 5, 19))
    assert vectors() is None
    words = packing._words(PATH)
    assert index() is None and packing._words(PATH) is words
