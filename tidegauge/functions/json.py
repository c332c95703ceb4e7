"""Tolerant reads of JSON text columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The sentinels readers of these logs rely on.
MISSING, EMPTY, NULL = "<missing>", "<empty>", "<null>"


def json_fields(data: Column) -> Column:
    """Top-level fields of a JSON object as texts; NULL when the text is no object. Parse once, read many fields."""
    return F.from_json(data, "map<string,string>")


def lenient_str(fields: Column, key: str, data: Column | None = None) -> Column:
    """Field as text: absent, blank and null get their own sentinel, bools are lower case, decimals lose trailing zeros.

    With the raw ``data`` given, containers name their kind; a look at the parsed document is taken only for texts that
    begin like a container.
    """
    text = F.element_at(fields, key)
    out = (F.when(fields.isNull() | ~F.map_contains_key(fields, key), MISSING).when(text.isNull(), NULL)
           .when(F.trim(text) == "", EMPTY))
    if data is not None:
        kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(data), f"$['{key}']", "variant"))
        opening = F.substring(text, 1, 1)
        out = out.when((opening == "{") & kind.startswith("OBJECT"), "object").when((opening == "[") & kind.startswith("ARRAY"), "array")
    return out.otherwise(text)


def lenient_long(fields: Column, key: str) -> Column:
    """Whole number, or a string holding one; anything else is 0."""
    text = F.element_at(fields, key)
    return F.coalesce(F.when(text.rlike(r"^\s*[-+]?\d+\s*$"), F.trim(text).try_cast("bigint")), F.lit(0).cast("bigint"))


def lenient_double(fields: Column, key: str) -> Column:
    """Number, or a string holding one; anything else is NULL."""
    return F.element_at(fields, key).try_cast("double")


def first_present(*texts: Column) -> Column:
    """First text that is not the missing sentinel."""
    return F.coalesce(*[F.when(t != MISSING, t) for t in texts], F.lit(MISSING))


def fields_match(want: Column, have: Column) -> Column:
    """Every wanted field is there with equal text. An unusable filter (NULL) or a payload that is no object matches."""
    equal = F.forall(F.map_entries(want), lambda e: F.map_contains_key(have, e["key"])
                     & (F.coalesce(F.element_at(have, e["key"]), F.lit("")) == F.coalesce(e["value"], F.lit(""))))
    return F.when(want.isNull() | have.isNull(), True).otherwise(equal)


def payload_match(wanted: Column, payload: Column) -> Column:
    """Every field of the filter object is in the payload with equal text.

    An empty or malformed filter matches everything, and so does a payload that is not an object.
    """
    return fields_match(json_fields(wanted), json_fields(payload))
