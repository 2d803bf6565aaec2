"""Bucket listing pages and the reports found through them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from dwitable.functions import paths as P
from dwitable.functions.columns import ColumnLike, col
from dwitable.operators.indexing import ordered_index
from dwitable.session import materialise

REPORT_SUFFIX = "_report.json"


def _element(name: str) -> str:
    """Pattern of a leaf element, its content verbatim."""
    return rf"<{name}(?:\s[^>]*)?>([^<]*)</{name}>"


def page_keys(xml: ColumnLike) -> Column:
    """All object keys of a listing page, as written there (entities are not resolved).

    Listings are flat, so a scan for the element is enough; building a document per page takes ten times as long.
    """
    return F.regexp_extract_all(col(xml), F.lit(_element("Key")), F.lit(1))


def page_truncated(xml: ColumnLike) -> Column:
    """Whether more pages follow."""
    return F.regexp_extract(col(xml), _element("IsTruncated"), 1) == "true"


def page_token(xml: ColumnLike) -> Column:
    """The encoded continuation token, NULL on the last page."""
    token = P.encode_component(F.regexp_extract(col(xml), _element("NextContinuationToken"), 1))
    return F.when(page_truncated(xml), token)


def parse_pages(pages: DataFrame) -> DataFrame:
    """Listing pages with their keys, truncation flag and token in place of the XML."""
    return pages.select(
        *[c for c in pages.columns if c != "xml"],
        page_keys("xml").alias("keys"), page_truncated("xml").alias("truncated"), page_token("xml").alias("token"),
    )


def _requests(pages: DataFrame) -> DataFrame:
    """What each request of a bucket leads to: ``(id, bucket, at, next, truncated, copies)``, ``at`` empty for the first one.

    The ``id`` is a number of its own, which is why the table is written. Of several stored copies of a page the smallest token counts; the page ends the listing only if all copies do.
    """
    following = F.nullif(page_token("xml"), F.lit(""))
    requests = pages.groupBy("bucket", F.coalesce("requested", F.lit("")).alias("at")).agg(
        F.min(following).alias("next"), F.bool_or(page_truncated("xml")).alias("truncated"), F.count(F.lit(1)).alias("copies"))
    return materialise(requests.select(F.monotonically_increasing_id().alias("id"), "*"), "requests")


def _reached(requests: DataFrame) -> DataFrame:
    """The requests that following tokens from a bucket's first page leads to: ``(id, position)``.

    The front doubles: it holds the first h pages of every chain, and the table of jumps says what lies h pages after a page. One
    join of the two gives the next h, one join of the jumps with themselves makes them twice as wide. So a chain of n pages
    takes about log n rounds, all buckets at once, and no join key repeats. A chain that comes back to a page finds it
    with a smaller position and ends there. Tokens are looked up once, then all rounds join numbers.
    """
    known = requests.select("bucket", F.col("at").alias("next"), F.col("id").alias("to"))
    jumps = materialise(requests.select("id", "bucket", "next").join(known, ["bucket", "next"]).select("id", "to"), "jumps")
    first = requests.where("at = '' and bucket is not null")
    front = materialise(first.select("id", F.lit(0).cast("long").alias("position")), "front")
    size, width = front.count(), 1
    while size:
        further = front.join(jumps, "id").select(F.col("to").alias("id"), (F.col("position") + width).alias("position"))
        met = Observation()
        front = materialise(front.unionByName(further).groupBy("id").agg(F.min("position").alias("position"))
                            .observe(met, F.count(F.lit(1)).alias("n")), "front")
        if met.get["n"] == size:
            break
        size, width = met.get["n"], 2 * width
        ahead = jumps.select(F.col("id").alias("to"), F.col("to").alias("far"))
        jumps = materialise(jumps.join(ahead, "to").select("id", F.col("far").alias("to")), "jumps")
    return front


def chained_pages(pages: DataFrame) -> DataFrame:
    """Stored listing pages with their ``position`` in the listing of their bucket.

    ``pages`` has ``(bucket, requested, xml)``: the encoded token that a page was asked for with, NULL for the first page. The
    position counts from 0 along the continuation tokens; it is NULL for pages that the first one does not lead to.
    Copies of a page share a position.
    """
    requests = _requests(pages)
    place = requests.join(_reached(requests), "id").select(F.col("bucket").alias("_bucket"), F.col("at").alias("_at"), "position")
    same = (F.col("bucket") == F.col("_bucket")) & (F.coalesce("requested", F.lit("")) == F.col("_at"))
    return pages.join(place, same, "left").drop("_at", "_bucket")


def chain_report(pages: DataFrame) -> DataFrame:
    """Whether each bucket was listed to its end: ``(bucket, status, n_stored, n_pages, n_chained)``.

    ``complete``: the chain from the first page ends with a page that no other follows, and no page lies outside it.
    ``extra``: the same, with pages outside. ``cyclic``: the last page leads back into the chain. ``unfinished``: the page after the
    last one is not stored, and all pages are in the chain. ``broken``: the same, with pages outside, those after the gap.
    ``headless``: there is no first page.
    """
    requests = _requests(pages)
    chain = requests.join(_reached(requests), "id", "left")
    ends = chain.groupBy("bucket").agg(
        F.sum("copies").alias("n_stored"), F.count(F.lit(1)).alias("n_pages"), F.count("position").alias("n_chained"),
        F.max_by(F.struct("next", "truncated"), "position").alias("last"))
    back = chain.where("position is not null").select("bucket", F.col("at").alias("_next"), F.lit(True).alias("_back"))
    ends = ends.withColumn("_next", F.col("last.next")).join(back, ["bucket", "_next"], "left")
    whole = F.col("n_chained") == F.col("n_pages")
    status = (
        F.when(F.col("n_chained") == 0, "headless").when(F.col("_back"), "cyclic")
        .when(F.col("last.truncated"), F.when(whole, "unfinished").otherwise("broken"))
        .otherwise(F.when(whole, "complete").otherwise("extra"))
    )
    return ends.select("bucket", status.alias("status"), "n_stored", "n_pages", "n_chained")


def manifest_in_order(pages: DataFrame, suffix: str = REPORT_SUFFIX) -> DataFrame:
    """Distinct report keys of each bucket with their ``index``, in the order in which the listing first names them.

    Pages outside the chain are not part of the listing.
    """
    placed = chained_pages(pages).where("position is not null")
    named = placed.select("bucket", "position", F.posexplode(page_keys("xml")).alias("place", "key")).filter(F.col("key").endswith(suffix))
    first = named.groupBy("bucket", "key").agg(F.min(F.shiftleft("position", 32) + F.col("place")).alias("order"))
    return ordered_index(materialise(first, "manifest"), ["bucket"], "order", "index").select("bucket", "key", "index")


def report_keys(keys: DataFrame) -> DataFrame:
    """Keys of report documents."""
    return keys.filter(F.col("key").endswith(REPORT_SUFFIX))


def manifest(pages: DataFrame) -> DataFrame:
    """Distinct report keys over all pages."""
    return report_keys(pages.select(F.explode(page_keys("xml")).alias("key"))).distinct()


def read_reports(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Report documents with a quality-control block, read with a declared schema."""
    reports = spark.read.schema(schema).option("multiLine", "true").json(paths)
    return reports.filter("eddy_quad IS NOT NULL")


def reports_with_qc(bodies: DataFrame, schema: str) -> DataFrame:
    """The same from a table of document bodies."""
    parsed = bodies.select(*[c for c in bodies.columns if c != "body"], F.from_json("body", schema).alias("report"))
    return parsed.filter("report.eddy_quad IS NOT NULL")
