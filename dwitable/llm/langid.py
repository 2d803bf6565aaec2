"""Language of a text by hyperdimensional profiles of its letter triples."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwitable.llm.common import SLICE, crc_bucket, fresh, kept, sliced
from dwitable.session import BROADCAST_BYTES, settled, shared_dir

DIMENSIONS = 1024
SEED = 7
UNKNOWN = "und"
#: Vectors of triples that a worker remembers, and entries of a count matrix that are bundled at once.
KNOWN_TRIPLES, ENTRIES = 16_384, 4096
#: Prototypes that a worker sums up or compares at once.
BLOCK_LANGUAGES = 2000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=2048)
def _letter_vector(code: int) -> np.ndarray:
    """The random vector of one letter, entries 1 and -1, the same in every process."""
    return (np.random.default_rng((SEED, code)).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1).astype(np.int8)


def _triple_vector(code: int) -> np.ndarray:
    """A triple binds its letters: the first permuted twice, the second once, multiplied with the third."""
    a, b, c = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
    return np.roll(_letter_vector(a), 2) * np.roll(_letter_vector(b), 1) * _letter_vector(c)


class Triples:
    """Vectors of letter triples, remembered up to a bound."""

    def __init__(self) -> None:
        self.rows: dict[int, int] = {}
        self.vectors = np.empty((KNOWN_TRIPLES, DIMENSIONS), np.int8)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        codes = codes.tolist()
        missing = [c for c in codes if c not in self.rows]
        if len(self.rows) + len(missing) > KNOWN_TRIPLES:
            self.rows, missing = {}, codes
        for c in missing:
            self.vectors[len(self.rows)] = _triple_vector(c)
            self.rows[c] = len(self.rows)
        return self.vectors[[self.rows[c] for c in codes]].astype(np.float32)


def _triples() -> Triples:
    return kept("langid", None, Triples)


def triple_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the triples of lower-cased letters; other characters between letters are one blank."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.concatenate([[32], np.where(letter, codes, 32), [32]]).astype(np.int64)
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
    return np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)


def bundles(texts: list[str | None]) -> np.ndarray:
    """One vector for each text: the sum of the vectors of its triples, at length 1; 0 without a letter."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    triples, doc, code, count, size = _triples(), [], [], [], 0

    def add() -> None:
        docs, codes, counts = np.concatenate(doc), np.concatenate(code), np.concatenate(count)
        for start in range(0, len(docs), ENTRIES):
            d, c, n = (x[start : start + ENTRIES] for x in (docs, codes, counts))
            unique, at = np.unique(c, return_inverse=True)
            matrix = np.zeros((d[-1] - d[0] + 1, len(unique)), np.float32)
            matrix[d - d[0], at] = n
            out[d[0] : d[-1] + 1] += matrix @ triples(unique)

    for i, text in enumerate(texts):
        codes, counts = triple_counts(text)
        if codes.size:
            doc.append(np.full(codes.size, i))
            code.append(codes)
            count.append(counts)
            size += codes.size
        if size and (size >= ENTRIES or i == len(texts) - 1):
            add()
            doc, code, count, size = [], [], [], 0
    if size:
        add()
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=out, where=length > 0)


@dataclass
class Prototypes:
    """A prototype for each language, in the order of their names: at hand if they are small, else read in blocks from a table."""

    names: list[str]
    matrix: np.ndarray | None
    path: str | None = None

    def blocks(self) -> Iterator[tuple[list[str], np.ndarray]]:
        if self.path is None:
            if self.names:
                yield self.names, self.matrix
            return
        store, root = pyarrow.fs.FileSystem.from_uri(self.path if ":" in self.path.split("/")[0] else f"file://{self.path}")
        files = sorted(f.path for f in store.get_file_info(pyarrow.fs.FileSelector(root)) if f.base_name.startswith("part-"))
        for file in files:
            for batch in pyarrow.parquet.ParquetFile(store.open_input_file(file)).iter_batches(BLOCK_LANGUAGES):
                if batch.num_rows:
                    yield batch.column(0).to_pylist(), _matrix(batch.column(1))


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as a matrix."""
    return np.asarray(vectors.flatten() if isinstance(vectors, pa.Array) else vectors.combine_chunks().flatten(), np.float32).reshape(-1, DIMENSIONS)


def _summed(found: Iterator[tuple[str, np.ndarray]], most: int) -> Iterator[pa.RecordBatch]:
    """Sums of vectors by language, in rounds of at most ``most`` languages."""
    totals: dict[str, np.ndarray] = {}

    def batch() -> pa.RecordBatch:
        vectors = pa.array(np.stack(list(totals.values())).reshape(-1))
        return pa.record_batch([pa.array(list(totals)), pa.FixedSizeListArray.from_arrays(vectors, DIMENSIONS).cast(pa.list_(pa.float64()))], ["lang", "vector"])

    for lang, vector in found:
        if lang not in totals and len(totals) >= most:
            yield batch()
            totals = {}
        totals[lang] = totals.get(lang, 0) + vector
    if totals:
        yield batch()


def learn(docs: DataFrame, sample_per_language: int = 3000, at_hand_bytes: int = BROADCAST_BYTES) -> Prototypes:
    """A prototype for each value of ``lang``: the bundle of its documents' vectors, at length 1.

    Every language learns from a sample of about ``sample_per_language`` documents, chosen by a hash of the text, so the model
    and the time to make it do not grow with a language's documents. There may be any number of languages: prototypes are a
    table, which tasks read in blocks unless it has at most ``at_hand_bytes``. Rows with a null lang, and texts without a
    letter, teach nothing.
    """
    known = docs.select("text", "lang").where("lang is not null")
    counts = settled(known.groupBy("lang").agg((sample_per_language / F.count(F.lit(1))).alias("share")), "languages")
    sample = known.join(counts, "lang").where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.least(F.col("share"), F.lit(1.0)) * (1 << 20))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[str, np.ndarray]]:
            for batch in sliced(batches):
                vectors = bundles(batch.column(0).to_pylist())
                langs = np.asarray(batch.column(1).to_pylist(), object)
                for lang in sorted(set(langs)):
                    yield lang, vectors[langs == lang].sum(axis=0, dtype=np.float64)

        yield from _summed(found(), BLOCK_LANGUAGES)

    def prototypes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[str, np.ndarray]]:
            for batch in sliced(batches):
                yield from zip(batch.column(0).to_pylist(), _matrix(batch.column(1)), strict=True)

        for batch in _summed(found(), 1):  # a language's parts follow each other
            vector = _matrix(batch.column(1))[0]
            size = float(np.linalg.norm(vector))
            if size > 0:
                yield pa.record_batch([batch.column(0), pa.array([(vector / np.float32(size)).tolist()], pa.list_(pa.float32()))], ["lang", "vector"])

    parts = sample.select("text", "lang").mapInArrow(sums, "lang string, vector array<double>")
    summed = parts.repartition("lang").sortWithinPartitions("lang").mapInArrow(prototypes, "lang string, vector array<float>")
    path = shared_dir(docs.sparkSession, "prototypes")
    summed.write.parquet(f"{path}/summed")
    written = docs.sparkSession.read.schema("lang string, vector array<float>").parquet(f"{path}/summed")
    if written.count() * DIMENSIONS * 4 <= at_hand_bytes:
        rows = written.toArrow().sort_by("lang")
        return Prototypes(rows.column(0).to_pylist(), _matrix(rows.column(1)))
    written.orderBy("lang").write.parquet(f"{path}/ordered")
    return Prototypes([], None, f"{path}/ordered")


def predicted(model: Prototypes, text: str = "text") -> Column:
    """A struct ``(lang_pred, score)`` of a text column: the nearest prototype and the cosine to it, 0 if that is negative.

    ``und`` with score 0 for a null text, one without a letter, and any text if no language was learned. Equal cosines go to
    the language that comes first by name.
    """
    rows = SLICE if model.path is None else 16 * SLICE

    @F.arrow_udf("lang_pred string, score double")
    def predict(found: pa.Array) -> pa.Array:
        langs, scores = [], []
        for start in range(0, len(found), rows):
            vectors = bundles(found.slice(start, rows).to_pylist())
            lang, score = np.full(len(vectors), UNKNOWN, object), np.full(len(vectors), -2.0, np.float32)
            for names, matrix in model.blocks():
                near = vectors @ matrix.T
                best = near.argmax(axis=1)
                near = near[np.arange(len(best)), best]
                better = near > score
                score[better] = near[better]
                lang[better] = np.asarray(names, object)[best[better]]
            some = vectors.any(axis=1) & (score > -2)
            langs += np.where(some, lang, UNKNOWN).tolist()
            scores.append(np.where(some, np.clip(score, 0, 1), 0.0).astype(float))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["lang_pred", "score"])

    return predict(text)


def held_out(modulus: int = 4, rest: int = 2) -> Column:
    """Documents that teach nothing: those whose crc32(doc_id) leaves ``rest``; not a row without a doc_id."""
    return F.coalesce(crc_bucket("doc_id", modulus) == rest, F.lit(False))


def identify(docs: DataFrame, sample_per_language: int = 3000) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every document, learned from those that are not held out.

    Null and empty texts and an input without any learned language give ``und`` with score 0. Repeated rows are predicted alike.
    A null doc_id is not held out. An empty table gives an empty result; other columns are ignored.
    """
    model = learn(docs.where(~held_out()), sample_per_language)
    found = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), predicted(model).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def with_known_language(docs: DataFrame, least_score: float = 0.05, sample_per_language: int = 3000) -> DataFrame:
    """The documents whose language is recognised, all columns unchanged: not ``und``, and a cosine of at least ``least_score``.

    Chance alone gives a cosine of about 1 / sqrt(1024) = 0.03; short clean texts are often not far above 0.1.
    """
    model = learn(docs.where(~held_out()), sample_per_language)
    name = fresh("found")
    found = docs.withColumn(name, predicted(model))
    return found.where((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.score") >= least_score)).drop(name)
