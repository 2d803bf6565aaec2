"""Object keys as tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwitable.functions import paths as P
from dwitable.session import BROADCAST_ROWS, if_small, materialise, parts_of, settle, settled

SUBJECT_PATTERN = r"(?:^|/)sub-([^/]+)/"
SUBJECT_PLACE = r"^(?:(.*?)/)?(sub-[^/]+)/"


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """Paths below a directory as ``(key, size)``, without reading any content."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
        .select(F.col("path").alias("key"), F.col("length").alias("size"))
    )


#: Prefixes up to which a filter names each; they are then pushed to the scan. More become a table.
NAMED_PREFIXES = 16


def matching_keys(keys: DataFrame, prefix: str | Iterable[str] = "", suffix: str = "") -> DataFrame:
    """Keys with one of the prefixes and the suffix; none if the list of prefixes is empty.

    The plan does not grow with the number of prefixes: from some number on they are joined as a table.
    """
    prefixes = [prefix] if isinstance(prefix, str) else list(dict.fromkeys(prefix))
    ending = keys.filter(F.col("key").endswith(suffix))
    if len(prefixes) <= NAMED_PREFIXES:
        return ending.filter(reduce(lambda a, b: a | b, [F.col("key").startswith(p) for p in prefixes], F.lit(False)))
    table = keys.sparkSession.createDataFrame([(p,) for p in prefixes], "prefix string")
    return ending.join(key_prefixes(ending, table).select("key"), "key", "left_semi")


def key_prefixes(keys: DataFrame, prefixes: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Distinct keys that begin with one of a table's prefixes, with the longest such one: ``(key, prefix)``.

    NULL prefixes match nothing, the empty prefix matches every key. With at most ``limit`` prefixes a key has one candidate for
    each length that a prefix has, and each is looked up whole in every task. Object keys have at most 1,024 characters, so there
    are never more lengths than that. More prefixes are sorted among the keys.
    """
    wanted, small = settle(prefixes.select("prefix").where("prefix is not null").distinct(), "prefixes", limit)
    if not small:
        return _sorted_prefixes(keys, wanted)
    found = _fronts(keys.select("key"), wanted).join(F.broadcast(wanted), "prefix")
    return found.groupBy("key").agg(F.max(F.length("prefix")).alias("_length")).select("key", F.expr("left(key, _length)").alias("prefix"))


def _fronts(keys: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of a table of keys, each with every front that is as long as some wanted prefix."""
    lengths = F.broadcast(wanted.agg(F.array_sort(F.collect_set(F.length("prefix"))).alias("_lengths")))
    each = F.explode(F.filter("_lengths", lambda n: n <= F.length("key"))).alias("_length")
    return keys.join(lengths).select(*keys.columns, each).withColumn("prefix", F.expr("left(key, _length)")).drop("_length")


def _sorted_prefixes(keys: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key_prefixes`` for any number of prefixes: no key is copied, and a prefix of very many keys is no hot key of a join.

    Keys and prefixes are dealt out by ranges of their text and sorted; a prefix then stands before the keys that it begins, with
    nothing else in between. Only prefixes from earlier ranges are missed. These begin the first key without a prefix of its own
    range as well, so that key is looked up for all of the range.
    """
    parts = parts_of(keys) + parts_of(wanted)
    named = keys.select(F.col("key").alias("text")).where("text is not null").distinct()
    rows = named.withColumn("is_key", F.lit(True)).unionByName(wanted.select(F.col("prefix").alias("text"), F.lit(False).alias("is_key")))
    dealt = rows.repartitionByRange(parts, "text").sortWithinPartitions("text", "is_key")
    begun = dealt.select(F.col("text").cast("binary").alias("text"), "is_key").mapInArrow(_last_begun, "key binary, prefix binary")
    text = [F.col(c).cast("string").alias(c) for c in ("key", "prefix")]
    begun = materialise(begun.select(*text, F.spark_partition_id().alias("_part")), "begun")
    rest = begun.where("prefix is null").groupBy("_part").agg(F.min("key").alias("key"))
    fronts = settled(_fronts(rest, wanted).select("_part", "prefix"), "fronts")
    earlier = wanted.join(fronts, "prefix").groupBy("_part").agg(F.collect_list("prefix").alias("_earlier"))
    own = F.array_max(F.filter("_earlier", lambda p: F.col("key").startswith(p)))  # of one key's fronts the longest sorts last
    found = begun.join(settled(earlier, "earlier"), "_part", "left").select("key", F.coalesce("prefix", own).alias("prefix"))
    return found.where("prefix is not null")


def _last_begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys among sorted texts, each with the longest prefix that came before it and begins it."""
    begun: list[bytes] = []
    for batch in batches:
        names, found = [], []
        for text, is_key in zip(batch["text"].to_pylist(), batch["is_key"].to_pylist(), strict=True):
            while begun and not text.startswith(begun[-1]):
                begun.pop()
            if is_key:
                names.append(text)
                found.append(begun[-1] if begun else None)
            else:
                begun.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(found, pa.binary())], ["key", "prefix"])


def subject_keys(roster: DataFrame, keys: DataFrame) -> DataFrame:
    """Raw and derivative keys of the roster's subjects: ``(subject_id, site, rd, key)``.

    Site and subject are read from the key, so an id that begins like another one does not match it. The subject is the first
    folder that begins with ``sub-``. The site is the folder above it, or above ``derivatives`` where that lies before the subject,
    with a tool's folder or without; a tree without such a folder has the site NULL, which matches a roster without site.
    """
    wanted = if_small(roster.select(F.col("subject_id").alias("_id"), F.col("site").alias("_site")).distinct())
    same = (F.col("subject_id") == F.col("_id")) & F.col("site").eqNullSafe(F.col("_site"))
    return placed_keys(keys).join(wanted, same, "left_semi")


def placed_keys(keys: DataFrame) -> DataFrame:
    """Keys below a subject's folder with what their path says: ``(subject_id, site, rd, key)``."""
    above = F.regexp_extract("key", SUBJECT_PLACE, 1)
    parsed = keys.select("key", F.regexp_extract("key", SUBJECT_PLACE, 2).alias("subject_id"), above.alias("_above"))
    derived = F.col("_above").rlike(r"(^|/)derivatives(/|$)")
    site = F.substring_index(F.regexp_replace("_above", r"(^|/)derivatives(/.*)?$", ""), "/", -1)
    return parsed.filter("subject_id <> ''").select(
        "subject_id", F.nullif(site, F.lit("")).alias("site"),
        F.when(derived, F.lit("deriv")).otherwise(F.lit("raw")).alias("rd"), "key",
    )


def unplaced_keys(keys: DataFrame) -> DataFrame:
    """The keys that lie below no subject's folder, which ``subject_keys`` leaves out."""
    return keys.filter(F.regexp_extract("key", SUBJECT_PLACE, 2) == "").select("key")


def bids_subjects(keys: DataFrame, subject: str | None = None) -> DataFrame:
    """Distinct subject labels of a tree, without their ``sub-``; or the one asked for."""
    label = F.regexp_extract("key", SUBJECT_PATTERN, 1)
    found = keys.select(label.alias("subject")).filter("subject <> ''")
    return (found if subject is None else found.filter(F.col("subject") == subject)).distinct()


def output_files(keys: DataFrame, output_dir: str, pipeline: str, subject: str | None = None) -> DataFrame:
    """Output files to upload with their object key: those below ``<subject>/<pipeline>/``."""
    relative = P.upload_key("key", output_dir)
    inside = F.col("key").startswith(output_dir.rstrip("/") + "/")
    rows = keys.filter(inside).select("key", relative.alias("object_key"))
    who = F.split_part("object_key", F.lit("/"), F.lit(1))
    area = F.split_part("object_key", F.lit("/"), F.lit(2))
    chosen = who.startswith("sub-") if subject is None else who == subject
    return rows.filter(chosen & (area == pipeline))
