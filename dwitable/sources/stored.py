"""Stored listing pages as a data source: ``spark.read.format("stored_listing").load(path)``.

A listing is kept as its pages, dealt out by ranges of bucket and key, beside a directory that says which keys each file holds. A
filter on the bucket or on the front of the key is answered from the directory: files without such keys are no tasks. The folder
must be one that ``pyarrow.fs`` opens on the driver and the executors.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from dwitable.sources.listing import page_keys

FORMAT = "stored_listing"
SCHEMA = "bucket string, key string, file string"
_KEY = re.compile(r"<Key(?:\s[^>]*)?>([^<]*)</Key>")
_OPEN = "\U0010ffff"


def write_listing(pages: DataFrame, path: str, files: int = 64) -> None:
    """Store ``(bucket, xml)`` pages below ``path``, in about ``files`` files, and the directory of the files.

    Pages lie by their first key, so the pages of one front of keys lie together, also in a bucket that holds most
    of them. Pages without a key are left out, as are copies of a page.
    """
    keys = page_keys("xml")
    known = pages.select(F.col("bucket").cast("string").alias("bucket"), F.array_min(keys).alias("first"), F.array_max(keys).alias("last"), "xml")
    known = known.where("first is not null").distinct()
    known.repartitionByRange(files, "bucket", "first").sortWithinPartitions("bucket", "first").write.parquet(f"{path}/pages")
    stored = pages.sparkSession.read.parquet(f"{path}/pages").select("bucket", "first", "last", F.col("_metadata.file_name").alias("file"))
    held = stored.groupBy("file", "bucket").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count(F.lit(1)).alias("pages"))
    held.coalesce(1).write.parquet(f"{path}/directory")


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Keys of a stored listing as ``(bucket, key, file)``, one row for each time a page names a key.

    Conditions ``bucket =``, ``bucket in``, ``key =`` and ``key`` starts with are answered by the source; Spark does the others.
    Filters reach sources in Python only with the session's ``spark.sql.python.filterPushdown.enabled``, which is set here.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoredListing)
    return spark.read.format(FORMAT).load(path)


def _store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class StoredListing(DataSource):
    """The format of ``write_listing``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options["path"])


class ListedFile(InputPartition):
    """One file of pages, and the buckets in it that are wanted."""

    def __init__(self, file: str, buckets: list[str]):
        super().__init__((file, buckets))
        self.file, self.buckets = file, buckets


class ListingReader(DataSourceReader):
    """A task for each file that may hold wanted keys."""

    def __init__(self, path: str):
        self.path = path
        self.buckets: set[str] | None = None
        self.fronts: list[str] = []
        self.exact: str | None = None
        self.none = False

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for one in filters:
            if isinstance(one, StringStartsWith) and one.attribute == ("key",):
                self.fronts.append(one.value)
            elif isinstance(one, EqualTo) and one.attribute == ("key",):
                self.none |= self.exact is not None and self.exact != one.value
                self.exact = one.value
            elif isinstance(one, EqualTo | In) and one.attribute == ("bucket",):
                asked = {one.value} if isinstance(one, EqualTo) else set(one.value)
                self.buckets = asked if self.buckets is None else self.buckets & asked
            else:
                yield one

    def _range(self) -> tuple[str, str]:
        """The least and the greatest key that the conditions allow."""
        low = max([*self.fronts, *([] if self.exact is None else [self.exact])], default="")
        high = min([*(f + _OPEN for f in self.fronts), *([] if self.exact is None else [self.exact])], default=_OPEN)
        return low, high

    def partitions(self) -> Sequence[InputPartition]:
        low, high = self._range()
        if self.none:
            return []
        store, root = _store(f"{self.path}/directory")
        rows = ds.dataset(root, filesystem=store, format="parquet").to_table().to_pylist()
        files: dict[str, list[str]] = {}
        for r in rows:
            if r["last"] >= low and r["first"] <= high and (self.buckets is None or r["bucket"] in self.buckets):
                files.setdefault(r["file"], []).append(r["bucket"])
        return [ListedFile(f, sorted(b)) for f, b in sorted(files.items())]

    def read(self, partition: ListedFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file has wanted keys
            return
        store, root = _store(f"{self.path}/pages")
        low, high = self._range()
        wanted = pc.field("bucket").isin(partition.buckets) & (pc.field("last") >= low) & (pc.field("first") <= high)
        pages = ds.dataset(f"{root}/{partition.file}", filesystem=store, format="parquet").scanner(["bucket", "xml"], filter=wanted, batch_size=64)
        for batch in pages.to_batches():
            buckets, keys = [], []
            for bucket, xml in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = [k for k in _KEY.findall(xml) if self._asked(k)]
                keys += mine
                buckets += [bucket] * len(mine)
            yield pa.record_batch([pa.array(buckets, pa.string()), pa.array(keys, pa.string()), pa.array([partition.file] * len(keys), pa.string())],
                                  ["bucket", "key", "file"])

    def _asked(self, key: str) -> bool:
        return all(key.startswith(f) for f in self.fronts) and (self.exact is None or key == self.exact)
