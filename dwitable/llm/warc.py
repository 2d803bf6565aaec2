"""Web archives with a two-level capture index."""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwitable.llm.common import sliced
from dwitable.session import if_small, materialise, shared_dir

#: Payloads below this size are always written in full.
LEAST_REVISIT = 100
#: Lines of an index block, and bytes after which a new archive file begins.
BLOCK_LINES, FILE_BYTES = 1000, 256 << 20
#: Blocks of an index file; its directory is held in memory by who reads it.
SHARD_BLOCKS = 10_000
#: Lines of the index that a task of a look-up reads, and places that it brings into the archive's order at once.
LINES_A_TASK, PLACES = 10 * BLOCK_LINES, 4096
#: Archive files that a task keeps open.
OPEN_FILES = 64
CAPTURED = "2000-01-01T00:00:00Z"


def open_store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder that all executors share, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def url_key(url: str | None) -> str:
    """The sort key of a URL: host labels from the last to the first, then path and query; an empty key for no URL."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and (parts.scheme, parts.port) not in (("http", 80), ("https", 443)) else ""
    except ValueError:
        return url.strip().lower()
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{query}"


def _clean(value: str | None) -> str:
    return "".join(c for c in value or "" if c not in "\r\n\0")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: a response with the page as payload, or a revisit that names the response with the same payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind, body = ("response", http + payload) if refers_to is None else ("revisit", http)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
             f"WARC-Target-URI: {_clean(url)}", f"WARC-Date: {CAPTURED}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's type, ids, digest as written, and payload; ValueError if it is cut off."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if not mark or not version.startswith("WARC/") or len(rest) < size:
        raise ValueError("broken record")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    page = lambda name: int(x) if (x := fields.get(name, "")[10:-1]) else None
    length = int(http.rsplit(b"Content-Length: ", 1)[1])
    return {"type": fields["WARC-Type"], "page_id": page("WARC-Record-ID"), "refers_to": page("WARC-Refers-To"),
            "url": fields["WARC-Target-URI"], "digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
            "payload": payload, "length": length}


def _gzip(data: bytes) -> bytes:
    """One gzip member, the same bytes each time."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


CAPTURES = "key string, page_id long, file string, offset long, length long"
SHARDS = "shard string, first_key string, first_page long, lines long, blocks long, directory long"


def write_archive(pages: DataFrame, folder: str, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Writes a gzip member per page to WARC files below ``folder`` and returns where each is: ``CAPTURES``.

    Of pages with equal payloads of at least ``least_revisit`` bytes the one with the smallest page_id is a response and the others
    revisit it; rows that repeat that page_id are responses as well. A page without an id is a response, and none is revisited.
    Each task writes files of its own under a fresh name, and only those of the attempt that Spark commits are listed.
    """
    digest = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), digest.alias("digest"),
                          F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes"))
    known = narrow.where(f"page_id is not null and bytes >= {least_revisit}")
    first = known.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    first = if_small(materialise(first.where("first < last").select("digest", "first"), "digests"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"),
                        digest.alias("digest"))
    rows = rows.join(first, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        out, name, offset = None, None, 0
        for batch in sliced(batches):
            found = []
            for page_id, url, html, sha, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    store.create_dir(path, recursive=True)
                    out, offset = store.open_output_stream(f"{path}/{name}", compression=None), 0
                data = _gzip(record(page_id, url, html.encode(), sha, refers_to))
                out.write(data)
                found.append((url_key(url), page_id, name, offset, len(data)))
                offset += len(data)
                if offset >= FILE_BYTES:
                    out.close()
                    out = None
            columns = list(zip(*found, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, (
                pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)],
                ["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return materialise(rows.mapInArrow(write, CAPTURES), "captures")


def _order(key: str | None, page_id: int | None) -> tuple:
    return (key or "").encode(), page_id is not None, page_id or 0


class _ShardWriter:
    """One file of the index: compressed blocks, then the directory."""

    def __init__(self, store: pyarrow.fs.FileSystem, path: str, first: tuple, block_lines: int):
        self.name = f"index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        store.create_dir(path, recursive=True)
        self.out = store.open_output_stream(f"{path}/{self.name}", compression=None)
        self.first, self.block_lines = first[:2], block_lines
        self.directory: list[list] = []
        self.lines: list[str] = []
        self.offset = self.total = 0

    def _flush(self) -> None:
        data = zlib.compress("\n".join(self.lines).encode())
        self.out.write(data)
        self.directory[-1] += [self.offset, len(data)]
        self.offset += len(data)
        self.lines = []

    def add(self, row: tuple) -> None:
        if not self.lines:
            self.directory.append([row[0], row[1]])
        self.lines.append(json.dumps(row, ensure_ascii=False))
        self.total += 1
        if len(self.lines) >= self.block_lines:
            self._flush()

    def close(self) -> pa.RecordBatch:
        if self.lines:
            self._flush()
        self.out.write(zlib.compress(json.dumps(self.directory, ensure_ascii=False).encode()))
        self.out.close()
        values = (self.name, *self.first, self.total, len(self.directory), self.offset)
        types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.record_batch([pa.array([v], t) for v, t in zip(values, types, strict=True)],
                               ["shard", "first_key", "first_page", "lines", "blocks", "directory"])


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sorts captures into shards and returns the list of shards: ``SHARDS``.

    Captures are ordered by key and page_id, and dealt out by ranges of both, so a key with many captures is cut. A shard is
    a file of at most ``SHARD_BLOCKS`` compressed blocks of ``block_lines`` lines, then the block directory: the first key,
    place and size of each block, starting at byte ``directory``.
    """
    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        shard: _ShardWriter | None = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard is None:
                    shard = _ShardWriter(store, path, row, block_lines)
                shard.add(row)
                if len(shard.directory) > SHARD_BLOCKS:
                    yield shard.close()
                    shard = None
        if shard is not None:
            yield shard.close()

    return materialise(ordered.mapInArrow(write, SHARDS), "shards")


class _Shard:
    """A shard's directory and the block read last."""

    def __init__(self, store: pyarrow.fs.FileSystem, path: str, directory: int):
        self.file = store.open_input_file(path)
        self.blocks = json.loads(zlib.decompress(self.file.read_at(self.file.size() - directory, directory)))
        self.firsts = [_order(b[0], b[1]) for b in self.blocks]
        self.block = lru_cache(maxsize=2)(self._block)

    def _block(self, i: int) -> tuple[list[tuple], list[list]]:
        offset, size = self.blocks[i][2:]
        rows = [json.loads(x) for x in zlib.decompress(self.file.read_at(size, offset)).decode().split("\n")]
        return [_order(r[0], r[1]) for r in rows], rows

    def captures(self, key: str) -> Iterator[list]:
        """All captures of a key in this shard, found by two binary searches."""
        start = _order(key, None)
        i = max(0, bisect.bisect_left(self.firsts, start) - 1)
        while i < len(self.blocks) and self.firsts[i][0] <= start[0]:
            orders, rows = self.block(i)
            j = bisect.bisect_left(orders, start)
            while j < len(rows) and rows[j][0] == key:
                yield rows[j]
                j += 1
            if j < len(rows):
                return
            i += 1


FOUND = ("key string, page_id long, url string, record_type string, refers_to long, payload_bytes long, "
         "payload_digest string, payload binary")


def _read(opened, file: str, offset: int, size: int) -> dict:
    """The record at a place of an archive file; ValueError if its payload is not the one that was written."""
    found = parse(zlib.decompress(opened(file).read_at(size, offset), 31))
    if found["type"] == "response" and hashlib.sha256(found["payload"]).hexdigest() != found["digest"]:
        raise ValueError(f"broken payload in {file} at {offset}")
    return found


def look_up(urls: DataFrame, shards: DataFrame, index: str, archive: str, payloads: bool = False) -> DataFrame:
    """Every capture of the distinct ``url`` values, read from the archive through the index: ``FOUND``.

    URLs with one key are one. The list of shards, a row for each file of the index, tells in which shards a key may be. Lookups are
    dealt out by ranges of shard and key, to as many tasks as the index has parts of ``LINES_A_TASK`` lines, so a task reads
    neighbouring blocks of a shard and a shard is read by many. A task reads a shard's directory, searches it, reads a block's
    range, searches that, and reads the records' ranges in the order in which they lie. A key that fills many shards is read by
    as many tasks. ``payload`` is filled if ``payloads`` is set, for responses. Payload size and digest
    are those of the full payload; a response's digest is checked against what was read, a revisit names both.
    A null url is the empty key. URLs that are not there give no row; an empty index gives an empty result.
    """
    context = urls.sparkSession.sparkContext
    listed = sorted(((r["first_key"], r["first_page"], r["shard"], r["directory"], r["lines"]) for r in shards.collect()),  # one per file
                    key=lambda r: _order(r[0], r[1]))
    known = context.broadcast(([r[0].encode() for r in listed], [r[2] for r in listed], {r[2]: r[3] for r in listed}))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, names, _ = known.value
        for batch in batches:
            keys = sorted({url_key(x) for x in batch.column(0).to_pylist()})
            rows = [(k, n) for k in keys for n in names[max(0, bisect.bisect_left(firsts, k.encode()) - 1) :
                                                        bisect.bisect_right(firsts, k.encode())]]
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["key", "shard"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (index_store, index_path), (store, path) = open_store(index), open_store(archive)
        opened = lru_cache(maxsize=OPEN_FILES)(lambda file: store.open_input_file(f"{path}/{file}"))
        shard = lru_cache(maxsize=1)(lambda name: _Shard(index_store, f"{index_path}/{name}", known.value[2][name]))
        types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = ["key", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        rows, held, places = [], 0, []

        def out() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            rows.clear()
            return batch

        def found() -> Iterator[pa.RecordBatch]:
            """The records at the places, in the order in which they lie in the archive."""
            nonlocal held
            for file, offset, size, key, page_id in sorted(places, key=lambda p: p[:2]):
                x = _read(opened, file, offset, size)
                kept = x["payload"] if payloads and x["type"] == "response" else None
                rows.append((key, page_id, x["url"], x["type"], x["refers_to"], x["length"], x["digest"], kept))
                held += len(kept or b"")
                if len(rows) >= PLACES or held > 32 << 20:
                    yield out()
                    held = 0
            places.clear()

        for batch in batches:
            for key, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for _, page_id, file, offset, size in shard(name).captures(key):
                    places.append((file, offset, size, key, page_id))
                    if len(places) >= PLACES:
                        yield from found()
        yield from found()
        if rows:
            yield out()

    wanted = urls.select("url").distinct().mapInArrow(place, "key string, shard string").distinct()
    tasks = max(1, -(-sum(r[4] for r in listed) // LINES_A_TASK))
    return wanted.repartitionByRange(tasks, "shard", "key").sortWithinPartitions("shard", "key").mapInArrow(search, FOUND)


def archived(pages: DataFrame, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Writes pages to archives and an index in the shared folder, and reads every page back by its URL: ``FOUND``.

    A null html is an empty payload. Repeated rows are repeated captures. An empty table gives an empty result; other columns
    are ignored.
    """
    spark = pages.sparkSession
    archive, index = shared_dir(spark, "warc"), shared_dir(spark, "index")
    shards = write_index(write_archive(pages, archive, least_revisit), index)
    return look_up(pages, shards, index, archive)
