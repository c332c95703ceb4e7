"""Times, maps, JSON texts and digests as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# A time needs an explicit offset: without one it is not a point in time.
ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$"


def parse_utc(text: Column) -> Column:
    """ISO-8601 with an offset or Z as a timestamp; NULL for anything else."""
    return F.when(text.rlike(ISO), F.try_to_timestamp(text))


def epoch_text(seconds: Column) -> Column:
    """Epoch seconds as ``YYYY-MM-DD HH:MM:SS`` in UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")


def age_days(day: Column, today: Column) -> Column:
    return F.datediff(today, day)


def merge_counts(a: Column, b: Column) -> Column:
    """Two count maps added key by key; a missing key counts 0."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def get_or(counts: Column, key: Column, default: int = 0) -> Column:
    return F.coalesce(F.element_at(counts, key), F.lit(default))


def canonical_json(text: Column) -> Column:
    """A flat JSON object with its keys in order, so that equal objects have equal texts; NULL for anything else."""
    fields = F.from_json(text, "map<string,string>")
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields))), {"ignoreNullFields": "false"})


def text_digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)
