"""Texts put together for models and readers, and names and titles read out of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TAGS, MAX_DESCRIPTION = 15, 200


def for_embedding(text: Column, kind: Column, context: Column) -> Column:
    """``text (kind) [context]`` with the parts that there are."""
    return F.concat_ws(" ", text, F.concat(F.lit("("), kind, F.lit(")")), F.concat(F.lit("["), context, F.lit("]")))


def for_reranking(text: Column, date: Column, kind: Column) -> Column:
    """``[date] [kind] text``; missing parts are left out."""
    return F.concat_ws(" ", F.concat(F.lit("["), F.date_format(F.to_date(date), "yyyy-MM-dd"), F.lit("]")), F.concat(F.lit("["), kind, F.lit("]")), text)


def merged_tags(old: Column, new: Column, most: int = MAX_TAGS) -> Column:
    """Old tags, then new ones, each once in lower case, at most ``most``."""
    return F.slice(F.array_distinct(F.transform(F.concat(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>"))), F.lower)), 1, most)


def merged_description(old: Column, new: Column, most: int = MAX_DESCRIPTION) -> Column:
    """Both parts joined, unless the new one is in the old; cut to ``most`` characters."""
    both = F.when(F.coalesce(F.contains(old, new), F.lit(False)), old).otherwise(F.concat_ws("; ", F.nullif(old, F.lit("")), F.nullif(new, F.lit(""))))
    return F.substring(both, 1, most)


def capitalised_names(text: Column) -> Column:
    """Runs of one to four capitalised words, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Z][a-z]+(?: [A-Z][a-z]+){0,3})"), F.lit(1)))


def h1_title(markdown: Column) -> Column:
    """The first top-level header, or null."""
    found = F.trim(F.regexp_extract(markdown, r"(?m)^#[ \t]+(.+)$", 1))
    return F.when(found != "", found)


def with_json_tags(json: Column, tags: Column) -> Column:
    """A JSON object with its ``tags`` set, all else as it was; a null one counts as empty."""
    fields = F.coalesce(F.from_json(json, "map<string,variant>"), F.expr("map()").cast("map<string,variant>"))
    rest = F.map_filter(fields, lambda k, _: k != "tags")
    return F.to_json(F.map_concat(rest, F.create_map(F.lit("tags"), F.to_variant_object(tags))))


def parsed_time(text: Column) -> Column:
    """The UTC time of an ISO 8601 text; one without an offset is UTC, what is none is null."""
    plain = F.regexp_replace(F.trim(text), r"(?:Z|z)$", "+00:00")
    zoned = F.when(plain.rlike(r"[+-]\d\d:?\d\d$"), plain).otherwise(F.concat(plain, F.lit("+00:00")))
    return F.when(plain.rlike(r"^\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:[+-]\d\d:?\d\d)?)?$"), F.to_utc_timestamp(F.try_to_timestamp(F.when(F.length(plain) == 10, F.concat(plain, F.lit("T00:00:00+00:00"))).otherwise(zoned)), F.lit("UTC"))).cast("timestamp_ntz")
