"""Record shapes: requests, merges, slots, links, picks from arrays, names."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, NumericType


def said(df: DataFrame, column: str) -> Column:
    """Whether a column's value counts as given, by its type: not null, and not false, 0, or empty."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, BooleanType):
        given = c
    elif isinstance(kind, NumericType):
        given = c != 0
    elif isinstance(kind, (ArrayType, MapType)):
        given = F.size(c) > 0
    else:
        given = F.length(c.cast("string")) > 0
    return F.coalesce(given, F.lit(False))


def request(df: DataFrame, always: Sequence[str], optional: Sequence[str]) -> Column:
    """A JSON object that has the ``always`` columns as they are, unless null, and the ``optional`` ones only where their value
    counts as given. Values keep their types."""
    return F.to_json(F.struct(*(F.col(c) for c in always), *(F.when(said(df, c), F.col(c)).alias(c) for c in optional)))


def default(value: Column, there: Column, fallback: Column) -> Column:
    """A key's value, or the fallback where the key isn't there; a null under a key that is there stays null."""
    return F.when(there, value).otherwise(fallback)


def json_default(raw: Column, key: str, fallback: str) -> Column:
    """``default`` for a key of a JSON object as text."""
    return default(F.get_json_object(raw, f"$.{key}"), F.array_contains(F.json_object_keys(raw), key), F.lit(fallback))


def one_json(raw: Column) -> Column:
    """Whether a text is one JSON value and nothing else; parsing alone would pass over what follows the first value."""
    listed = F.concat(F.lit("["), raw, F.lit("]"))
    return F.coalesce(F.try_parse_json(listed).isNotNull() & (F.json_array_length(listed) == 1), F.lit(False))


def json_kind(raw: Column) -> Column:
    """What a JSON text holds: object, array, string, boolean, integer, number or null; malformed if it is none."""
    kind = F.schema_of_variant(F.try_parse_json(raw))
    return (
        F.when(~one_json(raw), "malformed").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean").when(kind == "BIGINT", "integer").when(kind == "VOID", "null").otherwise("number")
    )


def handle(raw: Column) -> dict[str, Column]:
    """A submitted job's handle, under the names that polling asks for."""
    parsed = F.from_json(raw, "uuid STRING, jobs STRUCT<subscription_key: STRING>")
    return {"task_uuid": parsed["uuid"], "subscription_key": parsed["jobs"]["subscription_key"]}


def statuses(raw: Column) -> Column:
    """The statuses of a JSON list of jobs, in order."""
    return F.transform(F.from_json(raw, "array<struct<status: string>>"), lambda j: j["status"])


def merge(first: Column, second: Column) -> Column:
    """Two maps as one; where both have a key the second's value stays, in the first's place."""
    kept = F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k))
    return F.map_concat(kept, second)


def slot_names(objects: DataFrame, key: str, slots: str) -> DataFrame:
    """The names in each object's slots in order, without the empty ones. Works inside the row: no shuffle."""
    return objects.select(key, F.filter(slots, lambda s: s.isNotNull()).alias("names"))


def without_links_to(links: DataFrame, socket: str) -> DataFrame:
    """All links but those into one socket; a link whose socket is null stays."""
    return links.where(~F.col("to_socket").eqNullSafe(F.lit(socket)))


def first_where_else_first(values: Column, match: Callable[[Column], Column]) -> Column:
    """The first entry that matches, else the first entry; null for an empty array."""
    return F.coalesce(F.get(F.filter(values, match), F.lit(0)), F.get(values, F.lit(0)))


def blob_name(prefix: Column, session: Column, micros: Column) -> Column:
    """``prefix_session_milliseconds.png``"""
    return F.concat(prefix, F.lit("_"), session.cast("string"), F.lit("_"), F.floor(micros / 1000).cast("bigint").cast("string"), F.lit(".png"))


def storage_reference(bucket: str, name: Column) -> Column:
    """What stands for a stored blob: ``storage:bucket/name``."""
    return F.concat(F.lit(f"storage:{bucket}/"), name)


def utc_day(seconds: Column) -> Column:
    """The day of an epoch second, in the session's time zone, which has to be UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def transpose(points: Column, width: int) -> Column:
    """Rows of ``width`` numbers as ``width`` columns."""

    def column(i: int) -> Column:
        return F.transform(points, lambda p: p[i])

    return F.array(*(column(i) for i in range(width)))


def key_kind(key: Column, trial: str) -> Column:
    """free_trial or private; null without a key."""
    return F.when(key == trial, "free_trial").when(F.length(key) > 0, "private")
