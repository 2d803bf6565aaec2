"""Sidecar documents as variants: parsed once, then asked for any number of properties of any type."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOCUMENT = "document"


def parsed(bodies: DataFrame, body: str = "body") -> DataFrame:
    """The documents with a variant ``document`` in place of their text; NULL for a NULL text and for one that is no JSON.

    ``is_json`` tells the two apart: NULL for a NULL text, else whether it could be read.
    """
    document = F.try_parse_json(F.col(body))
    rows = bodies.withColumn(DOCUMENT, document)
    return rows.withColumn("is_json", F.when(F.col(body).isNotNull(), F.col(DOCUMENT).isNotNull())).drop(body)


def _path(name: str) -> str:
    """A property, or one inside others where names are joined by ``/``. A name has one kind of quotation mark at most."""
    return "$" + "".join(f"[\"{part}\"]" if "'" in part else f"['{part}']" for part in name.split("/"))


def with_properties(documents: DataFrame, types: Mapping[str, str], names: Mapping[str, str] | None = None) -> DataFrame:
    """Properties of parsed documents as columns of the types asked for; NULL where absent, null, or of no such value.

    ``types`` says the type of each property, ``names`` the column that it becomes unless its own name is meant.
    """
    named = names or {}
    return documents.select("*", *[F.try_variant_get(DOCUMENT, _path(p), t).alias(named.get(p, p)) for p, t in types.items()])


def kind_of(value: Column) -> Column:
    """What a variant holds: object, array, string, number, boolean, null, or other."""
    schema = F.schema_of_variant(value)
    kinds = (("OBJECT", "object"), ("ARRAY", "array"), ("STRING", "string"), ("BOOLEAN", "boolean"), ("VOID", "null"))
    out = F.when(schema.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), "number")
    for prefix, kind in kinds:
        out = out.when(schema.startswith(prefix), kind)
    return out.otherwise("other")


def property_kinds(documents: DataFrame, by: str) -> DataFrame:
    """How many documents of each group have a property of each kind: ``(by, property, kind, n)``, top level only.

    More than one kind for a property is a schema that has drifted; ``n`` against the number of documents tells what is optional.
    """
    spark = documents.sparkSession
    known = documents.where(F.col(DOCUMENT).isNotNull()).select(F.col(by).alias(by), DOCUMENT)
    inside = known.lateralJoin(spark.tvf.variant_explode(F.col(DOCUMENT).outer())).where("key is not null")
    return inside.groupBy(by, F.col("key").alias("property"), kind_of(F.col("value")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def merged_schemas(documents: DataFrame, by: str) -> DataFrame:
    """The schema that all documents of each group fit: ``(by, schema, n)``; drifted properties are VARIANT in it."""
    return documents.groupBy(by).agg(F.schema_of_variant_agg(DOCUMENT).alias("schema"), F.count(DOCUMENT).alias("n"))


def drifted(documents: DataFrame, by: str) -> DataFrame:
    """Properties that are not of one kind in a group: ``(by, property, kinds)``, null aside."""
    kinds = property_kinds(documents, by).where("kind <> 'null'")
    found = kinds.groupBy(by, "property").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    return found.where(F.size("kinds") > 1)
