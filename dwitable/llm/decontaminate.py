"""Benchmark passages in documents: SimHash of item-sized windows, then exact shingle similarity."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwitable.llm.common import SLICE, fresh, kept, sliced
from dwitable.session import if_small, materialise

WORD = re.compile(r"\w+")
KNOWN_WORDS = 100_000
#: Items and characters of one pass over the documents; a larger benchmark takes several passes.
PASS_ITEMS, PASS_CHARS = 20_000, 32_000_000
#: Windows whose bits are held at once, and pairs of a window and an item whose blocks are compared at once.
SPAN, PAIRS = 1 << 13, 1 << 20
BYTES = 8
#: Fingerprints are indexed in so many blocks of equal width. Wide ones tell apart best: at radius 19 two blocks of 32 bits let 2 % of
#: random pairs pass (9 bits or fewer differ in one of them), eight of 8 bits would let 71 % pass.
BLOCKS = 2
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Words(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def words_of(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores of the lower-cased text."""
    return WORD.findall((text or "").lower())


def word_hashes(words: list[str], known: _Words) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every ``width`` consecutive words."""
    if words.size < width:
        return np.zeros(0, np.uint64)
    total = words.size - width + 1
    value = np.zeros(total, np.uint64)
    for i in range(width):
        value = value * _FACTOR + words[i : i + total]
    value = (value ^ (value >> np.uint64(30))) * _MIX
    return value ^ (value >> np.uint64(31))


def _fingerprints(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash bytes of the windows of ``size`` shingles at ``starts``, which lie in ``hashes``."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, BYTES), axis=1).astype(np.int32)
    sums = np.concatenate([np.zeros((1, bits.shape[1]), np.int32), bits.cumsum(axis=0, dtype=np.int32)])
    return np.packbits((sums[starts + size] - sums[starts]) * 2 > size, axis=1)


def similarity(a: list[str], b: list[str], width: int) -> float:
    """Shared over all shingles, each weighted by how often it occurs."""
    x, y = (Counter(zip(*(w[i:] for i in range(width)), strict=False)) for w in (a, b))
    every = sum((x | y).values())
    return sum((x & y).values()) / every if every else 0.0


def _blocks(prints: np.ndarray) -> np.ndarray:
    """The blocks of fingerprints as numbers, one row for each block."""
    return np.ascontiguousarray(np.ascontiguousarray(prints).view(f">u{BYTES // BLOCKS}").T.astype(f"u{BYTES // BLOCKS}"))


@dataclass
class _Group:
    """Items with equally many words."""

    length: int
    width: int
    items: list[int]
    prints: np.ndarray  # items x 8 bytes
    blocks: np.ndarray  # BLOCKS x items: the blocks of the fingerprints as numbers


class Benchmark:
    """Items indexed by their shingles and by the blocks of their fingerprints."""

    def __init__(self, rows: list[tuple[int, str]], width: int, radius: int):
        self.radius, self.width, self.known = radius, width, _Words()
        self.ids = [r[0] for r in rows]
        self.words = [words_of(r[1]) for r in rows]
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            if w:
                by_length.setdefault(len(w), []).append(i)
        self.groups: list[_Group] = []
        entries: dict[int, list[tuple[np.ndarray, int]]] = {}
        for length, items in sorted(by_length.items()):
            w = min(width, length)
            hashes = [shingle_hashes(word_hashes(self.words[i], self.known), w) for i in items]
            prints = np.concatenate([_fingerprints(h, np.zeros(1, np.int64), h.size) for h in hashes])
            entries.setdefault(w, []).extend((h, len(self.groups)) for h in hashes)
            self.groups.append(_Group(length, w, items, prints, _blocks(prints)))
        self.shingles: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for w, found in entries.items():
            value = np.concatenate([h for h, _ in found])
            group = np.concatenate([np.full(h.size, g) for h, g in found])
            order = np.lexsort((group, value))
            value, group = value[order], group[order]
            new = np.concatenate([[True], (value[1:] != value[:-1]) | (group[1:] != group[:-1])])
            seen = np.zeros(1 << 22, bool)
            seen[(value >> np.uint64(42)).astype(np.int64)] = True
            self.shingles[w] = value[new], group[new], seen

    def reached(self, group: _Group, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows and items of which one block differs in few enough bits, as numbers of rows.

        Within the radius the bits that differ are spread over the blocks, so one of these has no more than its share.
        """
        mine, most = _blocks(prints), self.radius // BLOCKS
        rows = max(1, PAIRS // max(1, len(group.items)))
        for start in range(0, len(prints), rows):
            for first in range(0, len(group.items), PAIRS):
                items = slice(first, first + PAIRS)
                near = np.bitwise_count(mine[0, start : start + rows, None] ^ group.blocks[0, None, items]) <= most
                for b in range(1, BLOCKS):
                    near |= np.bitwise_count(mine[b, start : start + rows, None] ^ group.blocks[b, None, items]) <= most
                w, k = np.nonzero(near)
                yield w + start, k + first

    def _starts(self, hashes: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each group of items the places of the document's shingles that one of its items has."""
        value, group, seen = self.shingles[width]
        maybe = np.flatnonzero(seen[(hashes >> np.uint64(42)).astype(np.int64)])
        low = np.searchsorted(value, hashes[maybe], "left")
        high = np.searchsorted(value, hashes[maybe], "right")
        count = high - low
        if not count.any():
            return
        at = np.repeat(maybe, count)
        entry = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        groups = group[entry]
        for g in np.unique(groups):
            yield int(g), at[groups == g]

    def matches(self, text: str | None, least: float) -> dict[int, tuple[float, int, int]]:
        """The best window of each item that is similar enough: similarity, first word, words."""
        words = words_of(text)
        if not words:
            return {}
        ids, found = word_hashes(words, self.known), {}
        for width in self.shingles:
            hashes = shingle_hashes(ids, width)
            if not hashes.size:
                continue
            for g, at in self._starts(hashes, width):
                group = self.groups[g]
                size = min(group.length - width + 1, hashes.size)
                # a window without any shared shingle has similarity 0; all others are compared
                first, last = np.maximum(at - size + 1, 0), np.minimum(at, hashes.size - size)
                marks = np.zeros(hashes.size - size + 2, np.int32)
                np.add.at(marks, first, 1)
                np.add.at(marks, last + 1, -1)
                starts = np.flatnonzero(marks.cumsum()[:-1])
                for block in np.split(starts, np.flatnonzero(np.diff(starts // SPAN)) + 1):
                    low = block[0]
                    prints = _fingerprints(hashes[low : block[-1] + size], block - low, size)
                    for w, k in self.reached(group, prints):
                        bits = np.bitwise_count(prints[w] ^ group.prints[k]).sum(axis=1)
                        for s, i in zip(block[w[bits <= self.radius]].tolist(), k[bits <= self.radius].tolist(), strict=True):
                            item, span = group.items[i], size + width - 1
                            known = found.get(item)
                            if known and known[0] == 1.0:
                                continue
                            alike = similarity(words[s : s + span], self.words[item], width)
                            if alike >= least and (not known or (alike, -s) > (known[0], -known[1])):
                                found[item] = alike, s, span
        return found


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 19) -> DataFrame:
    """Documents with a benchmark passage: ``(doc_id, item_id, similarity, start, words)``, one row for each item found.

    A window as long as the item, in words, slides over the whole document. Windows that share no shingle with an item of
    that length have similarity 0 and are passed over. The others' SimHash fingerprints of 64 bits are looked up in an
    index by 2 blocks: within ``radius`` bits at least one block differs in ``radius // 2`` bits or fewer, so no item
    within the radius is missed. What is found is verified: shingles of ``words`` words that are shared, over all
    of both, counted as often as they occur, must come to ``similarity``. At that bound fingerprints differ in about 10
    bits; the radius leaves room for chance. An item of fewer words is one shingle and must occur as it is; a document
    shorter than the item is one window. ``start`` and ``words`` tell the best window, the first of equal ones.

    Documents are not shuffled. The benchmark is read in passes of bounded size, one after the other; each reads the documents once.
    Null, empty and wordless texts and items never match. Repeated rows of a document give repeated rows; of rows
    with one item_id each counts. Null ids stay null. Empty tables give an empty result; other columns are ignored.
    """
    return _scanned(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, words, similarity, radius).drop("body")


def _index(name: str, rows: list[tuple[int, str]], words: int, radius: int) -> Benchmark:
    """The index that this worker has built last, by a name of its own: the tasks of a worker share it."""
    return kept("decontaminate", name, lambda: Benchmark(rows, words, radius))


def _scanned(docs: DataFrame, benchmark: DataFrame, words: int, similarity: float, radius: int) -> DataFrame:
    """As ``contaminated`` for a table ``(doc_id, text)`` or ``(doc_id, text, body)``, with ``body`` or null in a last column."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null")
    size = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    passes = max(1, -(-size[0] // PASS_ITEMS), -(-size[1] // PASS_CHARS))
    schema = "doc_id long, item_id long, similarity double, start long, words long, body long"
    result = None
    for p in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p)
        rows = spark.sparkContext.broadcast(sorted({(r[0], r[1]) for r in part.collect()}, key=str))

        def scan(batches: Iterator[pa.RecordBatch], rows=rows, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            asked = _index(name, rows.value, words, radius)
            for batch in sliced(batches):
                out: list[tuple] = []
                bodies = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
                for doc_id, text, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bodies, strict=True):
                    for item, (alike, start, count) in asked.matches(text, similarity).items():
                        out.append((doc_id, asked.ids[item], alike, start, count, body))
                if out:
                    columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (
                        pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                    yield pa.record_batch(columns, ["doc_id", "item_id", "similarity", "start", "words", "body"])

        found = docs.mapInArrow(scan, schema)
        if passes > 1:  # written before the next pass begins, so that one pass's items are held at a time
            found = materialise(found, "leaks", batch_rows=SLICE)
            rows.unpersist()
        result = found if result is None else result.unionByName(found)
    return result


def without_benchmark(docs: DataFrame, benchmark: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 19) -> DataFrame:
    """The documents without a benchmark passage, all columns unchanged.

    Each row goes or stays by its own text: rows without a doc_id, or with one that other texts have too, are told apart by a
    hash of the text.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("body"))
    found = materialise(_scanned(texts, benchmark, words, similarity, radius).select("doc_id", "body").distinct(), "leaks", batch_rows=SLICE)
    id_, body = fresh("id"), fresh("body")
    found = if_small(found.withColumnRenamed("doc_id", id_).withColumnRenamed("body", body))
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(body)), "left_anti")
