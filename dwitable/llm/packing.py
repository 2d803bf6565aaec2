"""Token ids of documents packed into sequences of a fixed length."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwitable.llm.common import SLICE, kept, raw, sliced
from dwitable.session import materialise

#: Words whose ids a worker remembers, and bytes of text it splits at once.
KNOWN_WORDS, TEXT_BLOCK = 320_000, 1 << 20
#: Open windows merged in one group at the end; a group ends with at most one padded sequence.
MERGE_GROUP = 4096
WIDTH = 4  # bytes of an id


#: The characters that stand for bytes without one of their own in a byte-level vocabulary.
BYTE_CHARACTERS = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}
#: Letters below this one have lower-case forms of one character, but for the one beside it.
PLAIN_LETTERS, DOTTED = 0x250, 0x130
#: The runs of letters, the digits and the runs of other characters of a lower-case word of ASCII.
PARTS = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")
#: ASCII's marks without the apostrophe.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


pack_ids = [struct.Struct(f"<{n}I").pack for n in range(16)]


class _Known(dict):
    """Ids of words, encoded when they are first asked for; words that were not asked for lately are forgotten."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, word: bytes) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.encode(word)
        if len(self) >= KNOWN_WORDS // 2:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found


class WordIds:
    """The ids of a text, word by word, with a bounded memory of words.

    The tokenizer drops white space and never joins what white space separates, so the ids of a text are those of its words. Nor
    does it join letters, digits and other characters but after an apostrophe, so a word without one is made of its parts,
    which are far fewer than words. A run of letters alone is one piece to the tokenizer, so that its model can be asked
    directly.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = self.tokenizer.model.tokenize
        self.known = _Known(self._word)

    def _encode(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, text: str) -> bytes:
        ids = [p.id for p in self.pieces(text)]
        return pack_ids[len(ids)](*ids) if len(ids) < len(pack_ids) else struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if word.isascii():
            if word.isalpha():
                return self._letters(text)
            parts = PARTS.findall(word) if b"'" not in word else ()
            return b"".join(map(self.known.__getitem__, parts)) if len(parts) > 1 else self._encode(text)
        stem = text.rstrip(MARKS)
        if not stem.isalpha() or any(c >= PLAIN_LETTERS or c == DOTTED for c in map(ord, stem)):
            return self._encode(text)
        if len(stem) < len(text):
            return self.known[stem.encode()] + self.known[text[len(stem):].encode()]
        return self._letters(text.lower().encode().decode("latin-1").translate(BYTE_CHARACTERS))

    def ids(self, text: bytes) -> Iterator[bytes]:
        """Blocks of ids, four bytes each, little-endian."""
        if b"<|" in text:  # may hold a special token, which is matched before letters are lower-cased
            yield self._encode(text.decode())
            return
        start, known = 0, self.known.__getitem__
        while start < len(text):
            end = start + TEXT_BLOCK
            while end < len(text) and text[end - 1 : end] not in b" \t\n\r\x0b\x0c":  # go on to the end of the last word
                end += 1
            yield b"".join(map(known, text[start:end].lower().split()))
            start = end


def _words(path: str) -> WordIds:
    return kept("packing", path, lambda: WordIds(path))


class Windows:
    """A fixed number of open windows. Pieces are ``(doc, start, length, ids)``; full windows come out of ``place``."""

    def __init__(self, length: int, count: int, least_cut: int):
        self.length, self.count, self.least_cut = length, count, least_cut
        self.open: list[list] = []  # [used, pieces]

    def place(self, doc: int, start: int, ids: bytes) -> Iterator[list]:
        while ids:
            n = len(ids) // WIDTH
            if n >= self.length:
                yield [(doc, start, self.length, ids[: self.length * WIDTH])]
                start, ids = start + self.length, ids[self.length * WIDTH :]
                continue
            best = None
            for w in self.open:
                if w[0] + n <= self.length and (best is None or w[0] > best[0]):
                    best = w
            if best is None and len(self.open) < self.count:
                best = [0, []]
                self.open.append(best)
            if best is not None:
                best[0] += n
                best[1].append((doc, start, n, ids))
                if best[0] == self.length:
                    self.open.remove(best)
                    yield best[1]
                return
            fullest = max(self.open, key=lambda w: w[0])
            self.open.remove(fullest)
            room = self.length - fullest[0]
            if room >= self.least_cut:
                fullest[1].append((doc, start, room, ids[: room * WIDTH]))
                start, ids = start + room, ids[room * WIDTH :]
            yield fullest[1]


PIECES = "doc long, doc_id long, start long, length long, doc_tokens long, ids binary, part long, window long, offset long, open boolean"


def _packed(docs: DataFrame, path: str, length: int, windows: int, least_cut: int, end_id: int) -> DataFrame:
    """Pieces in windows, packed in each partition alone; what is still open at the end is marked."""
    end = int(end_id).to_bytes(WIDTH, "little")
    schema = pa.schema([("doc", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                        ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("part", pa.int64()), ("window", pa.int64()),
                        ("offset", pa.int64()), ("open", pa.bool_())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, state = _words(path), Windows(length, windows, least_cut)
        part, number, doc = TaskContext.get().partitionId(), 0, 0
        rows: list[tuple] = []
        totals: dict[int, list] = {}  # documents with pieces in open windows: doc_id, tokens, open pieces

        def put(pieces: list, is_open: bool) -> None:
            nonlocal number
            offset = 0
            for d, start, n, ids in pieces:
                known = totals[d]
                rows.append((d, known[0], start, n, known, ids, part, number, offset, is_open))
                offset += n
            number += 1

        def batch() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*rows, strict=True)]
            columns[4] = [k[1] for k in columns[4]]
            rows.clear()
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for found in sliced(batches):
            ids_of = found.column(0).cast(pa.int64()).to_pylist()
            for doc_id, text in zip(ids_of, raw(found.column(1)), strict=True):
                known = totals[doc] = [doc_id, 0]
                rest = b""
                for block in words.ids(text or b""):
                    rest += block
                    cut = len(rest) // (length * WIDTH) * length * WIDTH
                    if cut:
                        for pieces in state.place(doc, known[1], rest[:cut]):
                            put(pieces, False)
                        known[1], rest = known[1] + cut // WIDTH, rest[cut:]
                rest += end
                for pieces in state.place(doc, known[1], rest):
                    put(pieces, False)
                known[1] += len(rest) // WIDTH
                doc += 1
                if len(rows) >= SLICE:
                    yield batch()
                    alive = {p[0] for w in state.open for p in w[1]}
                    totals = {d: totals[d] for d in alive}
        for w in state.open:
            put(w[1], True)
        if rows:
            yield batch()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, PIECES)


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, windows: int = 64, least_cut: int = 16,
         end_id: int = 1) -> DataFrame:
    """Packed sequences, one row for each piece of a document in one.

    ``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``: ``ids`` are the piece's token ids, four bytes each,
    little-endian; ``start`` counts the ids of the document before it, ``doc_tokens`` all of them with the end id;
    ``offset`` is the place in the sequence. Each task keeps at most ``windows`` open windows. What a document has beyond whole
    sequences goes into the open window that it leaves the least room in. If it fits into none and no more may be
    opened, the fullest is given out; room of at least ``least_cut`` ids is first filled by cutting the piece, so less
    than that is padded. At the end the open windows of all tasks are laid end to end in groups and cut at the
    sequence length; only the last sequence of a group of ``MERGE_GROUP`` windows is short.

    Null and empty texts are the end id alone. Repeated rows and null doc_ids are packed like any other. An empty table gives no
    sequence. Other columns are ignored. ``tokenizer`` is the path of a tokenizer file that every executor has.
    """
    pieces = materialise(_packed(docs, tokenizer, length, windows, least_cut, end_id), "pieces", batch_rows=SLICE)
    columns = ["doc_id", "start", "length", "ids", "doc_tokens"]
    sequence = (F.col("part") * (1 << 31) + F.col("window")) * 2
    closed = pieces.where("not open").select(*columns, sequence.alias("sequence_id"), "offset")
    held = pieces.where("open").groupBy("part", "window").agg(F.sum("length").alias("used"))
    groups = max(1, -(-held.count() // MERGE_GROUP))
    held = held.withColumn("group", F.pmod(F.xxhash64("part", "window"), F.lit(groups)))
    # the windows of a group are numbers only, at most a few thousand of them
    base = held.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("part", "window", "used"))).alias("all"))
    base = base.select("group", F.inline("all")).selectExpr(
        "*", "sum(used) over (partition by group order by part, window rows unbounded preceding) - used as base")
    placed = pieces.where("open").join(base.select("group", "part", "window", "base"), ["part", "window"])
    at = F.col("base") + F.col("offset")
    first, last = F.floor(at / length), F.floor((at + F.col("length") - 1) / length)
    cut = placed.withColumn("at", at).withColumn("row", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("at"), F.col("row") * length)
    stop = F.least(F.col("at") + F.col("length"), (F.col("row") + 1) * length)
    cut = cut.withColumn("from", (begin - F.col("at")).cast("int")).withColumn("count", (stop - begin).cast("int"))
    merged = cut.select(
        "doc_id", (F.col("start") + F.col("from")).alias("start"), F.col("count").cast("long").alias("length"),
        F.substring("ids", F.col("from") * WIDTH + 1, F.col("count") * WIDTH).alias("ids"), "doc_tokens",
        ((F.col("group") * (1 << 31) + F.col("row")) * 2 + 1).alias("sequence_id"),
        (begin - F.col("row") * length).alias("offset"))
    return closed.unionByName(merged)
