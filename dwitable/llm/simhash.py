"""Near copies by SimHash fingerprints, compared exactly in tiles."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwitable.llm.common import SLICE, fresh, raw, sliced
from dwitable.llm.components import components
from dwitable.session import if_small, materialise

SEED = 42
BITS = 64
#: Tiles up to which the table of their neighbours is broadcast; a row has at most a number and a count for each move.
AROUND_ROWS = 200_000
#: Shingles whose bits are counted at once; bounds the memory of a long text.
BLOCK = 1 << 14


def fingerprint(text: bytes | None, words: int) -> int:
    """The SimHash of a text's shingles of ``words`` words, as an unsigned number; 0 without a word.

    Words are split at ASCII white space after A-Z are lower-cased. A text with fewer words is one shingle. A bit is 1 if
    more than half of the shingles, repeats included, have it.
    """
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    if len(parts) < words:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    total, digest, join = len(parts) - words + 1, xxhash.xxh64_digest, b" ".join
    counts = np.zeros(BITS, np.int64)
    for start in range(0, total, BLOCK):
        block = parts[start : start + BLOCK + words - 1]
        hashes = b"".join([digest(join(x), SEED) for x in zip(*(block[i:] for i in range(words)), strict=False)])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, BITS // 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, fingerprint)``; the fingerprint is the signed form of the 64 bits. A null text counts as empty."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(found):
            values = pa.array([_signed(fingerprint(x, words)) for x in raw(batch.column(1))], pa.int64())
            yield pa.record_batch([batch.column(0).cast(pa.int64()), values], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(batches, "doc_id long, fingerprint long")


def _popcounts(column: str, segments: int) -> list:
    width = BITS // segments
    mask = F.lit(_signed((1 << width) - 1))
    return [F.bit_count(F.shiftrightunsigned(column, width * i).bitwiseAND(mask)).cast("long") for i in range(segments)]


def _moves(segments: int, radius: int) -> list[list[int]]:
    """The differences of two population counts per segment that add up to at most ``radius``, in one direction each."""
    steps = [()]
    for _ in range(segments):
        steps = [(*x, d) for x in steps for d in range(-radius, radius + 1) if sum(map(abs, x)) + abs(d) <= radius]
    return [list(x) for x in steps if x > (0,) * segments]


def _close(own: np.ndarray, other: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what lies within the radius: at most as many per block as the block has fingerprints."""
    if not own.size or not other.size:
        return
    rows = max(1, (1 << 20) // other.size)
    for start in range(0, own.size, rows):
        block = own[start : start + rows]
        r, c = np.nonzero(np.bitwise_count(block[:, None] ^ other[None, :]) <= radius)
        if same:
            r, c = r[r + start < c], c[r + start < c]
        if r.size > block.size + other.size:
            left, right = np.arange(block.size), np.full(other.size, block.size)
            while True:
                before = left.copy()
                np.minimum.at(right, c, left[r])
                np.minimum.at(left, r, right[c])
                if (before == left).all():
                    break
            cols = np.flatnonzero(right < block.size)
            met = np.unique(r)
            yield (np.concatenate([block[met], other[cols]]), np.concatenate([block[left[met]], block[right[cols]]]))
        elif r.size:
            yield block[r], other[c]


def near_links(prints: DataFrame, radius: int, segments: int = 4, tile_rows: int = 4096) -> DataFrame:
    """Links ``(a, b)`` between the distinct fingerprints of ``prints`` that connect all pairs within ``radius`` bits.

    Every fingerprint lies in a tile named by the population counts of its ``segments`` parts. Two fingerprints differ in
    at least as many bits as their counts do, so a pair of tiles whose counts differ by more than the radius in sum is
    skipped, and all others are compared exactly, with exclusive-or and bit counts. A tile of more than ``tile_rows``
    fingerprints is cut by a hash; every piece meets every piece of its neighbours. One piece is held in memory, the
    fingerprints it is compared with pass by in batches. More segments give smaller tiles, at the price of more copies
    of a fingerprint; the links are the same.
    """
    # a tile is one number with a digit for each count; digits have room for a move, so that a move never carries over
    base = BITS // segments + 2 * radius + 1
    if base**segments >= 1 << 63:
        raise ValueError("too many segments for this radius")
    places = [base**i for i in range(segments)]
    code = sum((c * F.lit(b) for c, b in zip(_popcounts("fingerprint", segments), places, strict=True)), F.lit(0).cast("long"))
    tiled = prints.select("fingerprint", code.alias("tile"))
    tiles = materialise(tiled.groupBy("tile").count()
                        .select("tile", F.ceil(F.col("count") / tile_rows).cast("int").alias("pieces")), "tiles")
    moves = F.array(*[F.lit(sum(d * b for d, b in zip(m, places, strict=True))).cast("long") for m in _moves(segments, radius)])
    pairs = tiles.select("tile", F.explode(moves).alias("move")).select("tile", (F.col("tile") + F.col("move")).alias("anchor"))
    anchors = pairs.join(tiles.withColumnRenamed("tile", "anchor"), "anchor").groupBy("tile").agg(
        F.collect_list(F.struct("anchor", "pieces")).alias("around"))  # at most one entry for each move
    around = materialise(tiles.join(anchors, "tile", "left").select("tile", F.col("pieces").alias("own"), "around"), "tiles")
    piece = F.pmod(F.xxhash64("fingerprint"), F.col("own")).cast("int")
    placed = tiled.join(if_small(around, AROUND_ROWS), "tile").withColumn("piece", piece)
    at_home = F.transform(F.sequence(F.lit(0), F.col("piece")),
                          lambda i: F.struct(F.col("tile").alias("anchor"), i.alias("piece"),
                                             (i != F.col("piece")).alias("passing")))
    abroad = F.flatten(F.transform(F.coalesce("around", F.array()), lambda x: F.transform(
        F.sequence(F.lit(0), x["pieces"] - 1),
        lambda i: F.struct(x["anchor"].alias("anchor"), i.alias("piece"), F.lit(True).alias("passing")))))
    sent = placed.select("fingerprint", F.explode(F.concat(at_home, abroad)).alias("to")).select(
        F.xxhash64("to.anchor", "to.piece").alias("place"), "to.passing", "fingerprint")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, own, settled = None, [], True

        def links(pieces):
            for x, y in pieces:
                yield pa.record_batch([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

        def home():
            held = np.concatenate(own) if own else np.zeros(0, np.uint64)
            return held, links(_close(held, held, radius, True))

        held = np.zeros(0, np.uint64)
        for batch in batches:
            places = batch.column(0).to_numpy()
            passing = batch.column(1).to_numpy(zero_copy_only=False)
            values = batch.column(2).to_numpy().view(np.uint64)
            cuts = np.flatnonzero((places[1:] != places[:-1]) | (passing[1:] != passing[:-1])) + 1
            for start, end in itertools.pairwise([0, *cuts.tolist(), len(places)]):
                if start == end:
                    continue
                if places[start] != place:
                    if not settled:
                        yield from home()[1]
                    place, own, settled = places[start], [], False
                if not passing[start]:
                    own.append(values[start:end].copy())
                    continue
                if not settled:
                    held, found = home()
                    yield from found
                    settled = True
                yield from links(_close(held, values[start:end], radius, False))
        if not settled:
            yield from home()[1]

    return (sent.repartition("place").sortWithinPartitions("place", "passing")
            .mapInArrow(compare, "a long, b long"))


def segments_for(count: int) -> int:
    """Parts of a fingerprint that keep a tile's neighbourhood small as the number of fingerprints grows."""
    return 4 if count <= 8_000_000 else 8 if count <= 2_000_000_000 else 16


def near_copies(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """Every document with its fingerprint and its group: ``(doc_id, fingerprint, component_id)``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; ``component_id`` is the smallest doc_id
    that links reach, the document's own included. Equal fingerprints are one node, so copies are never paired up.
    Null and empty texts have the fingerprint 0 and are linked like any other. Repeated rows stay and share their group.
    A null doc_id stays, in the group of its fingerprint; a group without any doc_id has a null ``component_id``.
    An empty table gives an empty result; other columns are ignored.
    """
    prints = materialise(fingerprints(docs, words), "prints", batch_rows=SLICE)
    nodes = materialise(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "prints")
    links = near_links(nodes.select("fingerprint"), radius, segments_for(nodes.count()))
    groups = components(links, "a", "b").withColumnRenamed("node", "fingerprint")
    named = materialise(nodes.join(groups, "fingerprint"), "prints")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = named.join(least, "component").select("fingerprint", "component_id")
    alone = nodes.join(linked, "fingerprint", "left").select("fingerprint", F.coalesce("component_id", "first").alias("component_id"))
    classes = materialise(alone, "prints")
    return prints.join(if_small(classes), "fingerprint").select("doc_id", "fingerprint", "component_id")


def one_of_each(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """The documents without near copies: of each group the row with the smallest doc_id stays, all columns unchanged.

    Of rows that repeat a doc_id one stays. A row without a doc_id cannot be told apart from others and stays.
    """
    kept = materialise(near_copies(docs, words, radius).where("doc_id = component_id")
                       .groupBy("doc_id").agg(F.count("*").alias("copies")), "kept")
    copies = fresh("copies")
    kept = if_small(kept.withColumnRenamed("copies", copies).withColumnRenamed("doc_id", key := fresh("id")))
    joined = docs.join(kept, F.col("doc_id") == F.col(key)).drop(key)
    result = joined.where(F.col(copies) == 1).drop(copies).unionByName(docs.where("doc_id is null"))
    if kept.where(F.col(copies) > 1).isEmpty():
        return result
    return result.unionByName(joined.where(F.col(copies) > 1).drop(copies).dropDuplicates(["doc_id"]))
