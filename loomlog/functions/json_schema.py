"""Flat JSON schemas as column expressions: strict parsing, type tags, inference, validation.

A schema is a map of field to tag (string, number, integer, boolean, object, array, null). A payload's
fields are compared as a whole in one expression, so validation needs no rows per field and no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_END = "~eof~"


def allow_duplicate_keys(spark: SparkSession) -> None:
    """Of repeated keys in an object the last one counts."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often it is named."""
    return F.get(F.transform(F.array(value), body), 0)


def parse_strict(text: Column) -> Column:
    """The value of a whole JSON text as a variant; null if anything else stands before or after it.

    Spark's parser stops after the first value. Inside an array that ends with a mark, whatever follows the value either
    breaks the array or moves the mark.
    """
    def strict(whole: Column) -> Column:
        ends = F.try_variant_get(whole, "$[1]", "string").eqNullSafe(F.lit(_END)) & F.variant_get(whole, "$[2]", "variant").isNull()
        return F.when(ends, F.variant_get(whole, "$[0]", "variant"))

    return _let(F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]'))), strict)


def type_tag(value: Column) -> Column:
    """Tag of a variant. Whole numbers within 64 bits are integers however they are written."""
    def tag(x: Column) -> Column:
        kind, number = x["kind"], x["number"]
        whole = (number == F.floor(number)) & (F.abs(number) < F.lit(2.0**63))
        return (
            F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object")
            .when(kind == "VOID", "null").when(whole, "integer").otherwise("number")
        )

    return _let(F.struct(F.schema_of_variant(value).alias("kind"), value.try_cast("double").alias("number")), tag)


def fields(text: Column) -> Column:
    """Map of field to tag of a JSON object; empty for the JSON null, null for anything that is no object.

    Numbers out of the range of a double make the payload invalid. The text is parsed once.
    """
    def tagged(entries: Column) -> Column:
        infinite = F.exists(entries, lambda e: F.coalesce(F.abs(e["value"].try_cast("double")) == F.lit(float("inf")), F.lit(False)))
        return F.when(~infinite, F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), type_tag(e["value"]).alias("value")))))

    def of(value: Column) -> Column:
        none = F.create_map().cast("map<string,string>")
        return F.when(F.is_variant_null(value), none).otherwise(_let(F.map_entries(value.try_cast("map<string,variant>")), tagged))

    return _let(parse_strict(text), of)


def matches(expected: Column, actual: Column) -> Column:
    """Whether a field's tag satisfies the schema's: equal, or an integer where a number is expected."""
    return (expected == actual) | ((expected == "number") & (actual == "integer"))


def validates(tags: Column, schema: Column) -> Column:
    """Whether a payload with these fields is valid: all of the schema's fields, extra ones allowed; no schema allows all."""
    def by(found: Column) -> Column:
        every = F.forall(F.map_entries(schema), lambda e: F.coalesce(matches(e["value"], F.element_at(found, e["key"])), F.lit(False)))
        return F.when(found.isNull(), False).otherwise(every)

    return F.when(schema.isNull(), True).otherwise(_let(tags, by))
