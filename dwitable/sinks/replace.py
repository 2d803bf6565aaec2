"""Adding to an output folder: a write replaces the parts it has, and leaves those of other subjects as they are.

A write is staged beside the table, in folders that readers pass over. When it is whole, a commit list of the parts to replace is
put down, and the parts are moved one by one. A write that fails before that has changed nothing; one that is
interrupted while it moves is finished from its list by the next write, or by ``recover``. Moving needs a file system that
renames folders.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from threading import Event

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwitable.session import settled

STAGED, COMMITS, REPLACED, LAYOUT = "_staged", "_commits", "_replaced", "_layout"
#: Moves that wait for the file system at once, and parts that are worth a further one.
MOVERS, MOVER_PARTS = 16, 64


class _Folder:
    """Hadoop's view of a folder and the files below it."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.hadoop = self.jvm.org.apache.hadoop.fs  # looked up once: each look-up asks the JVM for every part of the name
        self.Path = self.hadoop.Path
        self.parents: set[str] = set()  # folders that moves have made
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, pattern: str) -> list[str]:
        """Names below the folder that match, relative to it."""
        base = len(self.fs.makeQualified(self.path("")).toString().rstrip("/")) + 1
        found = self.fs.globStatus(self.path(pattern))
        return [p.toString()[base:] for p in self.hadoop.FileUtil.stat2Paths(found)] if found else []

    def move(self, source: str, target: str) -> None:
        parent = target.rpartition("/")[0]
        if parent not in self.parents:
            self.fs.mkdirs(self.path(parent))
            self.parents.add(parent)
        if not self.fs.rename(self.path(source), self.path(target)):
            raise OSError(f"could not move {source} to {target} in {self.root}")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def write(self, name: str, text: str) -> None:
        """A file that is there whole or not at all."""
        draft = f"{STAGED}/{uuid.uuid4().hex}.draft"
        out = self.fs.create(self.path(draft))
        out.write(bytearray(text.encode()))
        out.close()
        self.move(draft, name)

    def read(self, name: str) -> str:
        found = self.fs.open(self.path(name))
        text = self.jvm.org.apache.commons.io.IOUtils.toString(found, "UTF-8")
        found.close()
        return text


def _place(folder: _Folder, write: str, part: str) -> None:
    """Move one part of a commit list, unless it has been moved already."""
    staged, former = f"{STAGED}/{write}/{part[1:]}", f"{REPLACED}/{write}/{part[1:]}"
    if part[0] == "+" and not folder.exists(staged):
        return
    if folder.exists(part[1:]) and not folder.exists(former):
        folder.move(part[1:], former)
    if part[0] == "+":
        folder.move(staged, part[1:])


def _finish(folder: _Folder, write: str) -> None:
    """Move what a commit list names, many parts at a time; parts that have been moved already are passed over."""
    parts = folder.read(f"{COMMITS}/{write}").splitlines()
    failed = Event()

    def place(part: str) -> None:
        if failed.is_set():
            return
        try:
            _place(folder, write, part)
        except BaseException:
            failed.set()
            raise

    with ThreadPoolExecutor(max(1, min(MOVERS, len(parts) // MOVER_PARTS))) as movers:
        for _ in movers.map(place, parts):
            pass
    folder.delete(f"{COMMITS}/{write}")
    folder.delete(f"{REPLACED}/{write}")
    folder.delete(f"{STAGED}/{write}")


def recover(spark: SparkSession, path: str) -> int:
    """Finish the writes below ``path`` that were interrupted after their commit list; returns how many those were."""
    folder = _Folder(spark, path)
    waiting = sorted(n.rsplit("/", 1)[-1] for n in folder.names(f"{COMMITS}/*"))
    for write in waiting:
        _finish(folder, write)
    return len(waiting)


def replace_parts(df: DataFrame, path: str, keys: Sequence[str], kind: str = "parquet", empty: Sequence[str] = ()) -> None:
    """Write a table below ``path`` with a folder for each value of the keys, in place of the former folders of those values.

    ``empty`` names further folders that go, unless the table has rows for them. Folders of other values stay. Two
    writes at the same time may go to different folders.
    """
    spark, write = df.sparkSession, uuid.uuid4().hex
    recover(spark, path)
    folder = _Folder(spark, path)
    try:
        df.write.partitionBy(*keys).format(kind).save(f"{folder.root}/{STAGED}/{write}")
    except Exception:
        folder.delete(f"{STAGED}/{write}")
        raise
    depth = "/".join(["*=*"] * len(keys))
    made = [n.split("/", 2)[2] for n in folder.names(f"{STAGED}/{write}/{depth}")]
    gone = [n for n in empty if n not in set(made)]
    folder.write(f"{COMMITS}/{write}", "".join(f"+{n}\n" for n in made) + "".join(f"-{n}\n" for n in gone))
    _finish(folder, write)


def replace_subjects(
    df: DataFrame, path: str, keys: Sequence[str], kind: str, bucket: str, buckets: int, order: Sequence[str] = (),
    spread: Sequence[str] = (), subjects: DataFrame | None = None,
) -> None:
    """Write rows of subjects that share ``buckets`` folders, in place of the former rows of these subjects.

    ``keys`` tell a subject, ``bucket`` names the column of folders. The rows of other subjects in the same folders are read and
    written again; folders without any of the subjects stay untouched. ``subjects`` are those that the write is about, if
    some have no rows any more. The number of folders of the first write holds for all.
    """
    spark, keys = df.sparkSession, list(keys)
    recover(spark, path)
    folder = _Folder(spark, path)
    there = folder.exists(LAYOUT)
    if there:
        buckets = int(folder.read(LAYOUT))
    place = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    about = (df if subjects is None else subjects.unionByName(df.select(*keys))).select(*keys).distinct()
    about = settled(about.withColumn(bucket, place), "subjects")
    touched = [r[0] for r in about.select(bucket).distinct().collect()]  # at most the number of folders
    rows = df.withColumn(bucket, place)
    if there and touched:
        former = spark.read.schema(df.schema).format(kind).load(path).where(F.col(bucket).isin(touched))
        same = [F.col(f"_f.{k}").eqNullSafe(F.col(f"_a.{k}")) for k in keys]
        rest = former.alias("_f").join(about.alias("_a"), same, "left_anti").select(*df.columns, bucket)
        rows = rows.unionByName(rest.withColumn(bucket, F.col(bucket).cast("int")))
    rows = rows.repartition(bucket, *spread).sortWithinPartitions(bucket, *order)
    replace_parts(rows, path, [bucket], kind, [f"{bucket}={n}" for n in touched])
    if not there:
        folder.write(LAYOUT, str(buckets))
