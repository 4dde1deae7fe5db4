"""JSON held in strings: typed attribute values, nested ids, model replies."""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip_fence


def unwrap_value(v):
    """{"S": x}, {"N": x}, {"BOOL": x}, {"M": {..}}, {"L": [..]} to plain values; anything else as it is."""
    if not isinstance(v, dict) or len(v) != 1:
        return v
    kind, inner = next(iter(v.items()))
    if kind == "N":
        for number in (int, float):
            try:
                return number(inner)
            except (TypeError, ValueError):
                continue
        return inner
    if kind == "M":
        return {k: unwrap_value(x) for k, x in inner.items()}
    if kind == "L":
        return [unwrap_value(x) for x in inner]
    return inner if kind in ("S", "BOOL") else v


def plain_number(x):
    """Decimals to integers when integral, else to floats, within lists and maps (JSN4)."""
    if isinstance(x, Decimal):
        return int(x) if x == x.to_integral_value() else float(x)
    if isinstance(x, dict):
        return {k: plain_number(v) for k, v in x.items()}
    return [plain_number(v) for v in x] if isinstance(x, (list, tuple)) else x


@F.pandas_udf(T.StringType())
def unwrap_typed(text: pd.Series) -> pd.Series:
    """Typed JSON to plain JSON; null for what is no JSON (JSN2)."""

    def one(t):
        try:
            return None if t is None else json.dumps(unwrap_value(json.loads(t)), ensure_ascii=False)
        except ValueError:
            return None

    return text.map(one)


def event_ids(events: Column) -> Column:
    """Distinct integers under any "eventId" key, plain or typed, in order (JSN3)."""
    found = F.regexp_extract_all(events, F.lit(r'"eventId"\s*:\s*(?:\{\s*"[NS]"\s*:\s*)?"?(-?\d+)'), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: x.cast("long")))


def event_ids_text(events: Column) -> Column:
    return F.nullif(F.array_join(event_ids(events), ","), F.lit(""))


def event_names(events: Column) -> Column:
    """Names in {"M":{"event":{"L":[{"M":{"eventName":{"S":..}}}]}}} or in plain JSON (FLT4)."""
    return F.regexp_extract_all(events, F.lit(r'"eventName"\s*:\s*(?:\{\s*"S"\s*:\s*)?"((?:[^"\\]|\\.)*)"'), F.lit(1))


def object_keys(text: Column) -> Column:
    """Keys of a JSON object; null for arrays, bad JSON and empty objects (FLT11)."""
    keys = F.json_object_keys(text)
    return F.when(F.size(keys) > 0, keys)


def or_default(text: Column, schema: str, default: str = "{}") -> Column:
    """Parsed, with a default for what cannot be parsed (JSN1)."""
    return F.coalesce(F.from_json(text, schema), F.from_json(F.lit(default), schema))


def error_blob(text: Column) -> Column:
    """First {...} in an error text, its retry delay in seconds and whether a daily quota ended (JSN6)."""
    delay = F.coalesce(F.regexp_extract(text, r"retryDelay\W+(\d+)", 1).try_cast("int"), F.lit(6))
    return F.struct(F.nullif(F.regexp_extract(text, r"(\{.*\})", 1), F.lit("")).alias("payload"), (F.greatest(delay, F.lit(1)) + 1).alias("wait_s"), text.contains("PerDay").alias("daily"))


def cluster_reply(reply: Column, least: int = 4) -> Column:
    """struct<cluster_id, title> of a model's reply (JSN5).

    In order: strict JSON; fields by pattern (confidence 5 unless told); a leading number (no confidence
    asked); NEW_CLUSTER: "title"; else a new cluster. Below the least confidence it is a new cluster too.
    """
    r = strip_fence(reply)
    struct = lambda cid, title: F.struct(cid.cast("long").alias("cluster_id"), title.alias("title"))
    none, empty = F.lit(None).cast("long"), F.lit("")
    j = F.from_json(r, "cluster_id string, title string, confidence string", {"mode": "PERMISSIVE"})
    is_json = F.try_parse_json(r).isNotNull() & r.startswith("{") & j["cluster_id"].isNotNull()
    number, confidence = j["cluster_id"].try_cast("long"), F.coalesce(j["confidence"], F.lit("0")).try_cast("int")
    def told_by(key: str, value: str) -> Column:  # "key": value, its value in quotes or not
        return F.nullif(F.regexp_extract(r, rf'{key}"\s*:\s*"?({value})', 1), empty)

    strict_new = is_json & (j["cluster_id"] == "NEW_CLUSTER")
    strict = is_json & number.isNotNull() & confidence.isNotNull()
    field = told_by("cluster_id", r"NEW_CLUSTER|\d+")
    told = F.coalesce(told_by("confidence", r"\d").try_cast("int"), F.lit(5))
    lead = F.nullif(F.regexp_extract(r, r"^(\d+)", 1), empty)
    return (
        F.when(strict_new, struct(none, F.trim(F.coalesce(j["title"], empty))))
        .when(strict & (confidence >= least), struct(number, empty))
        .when(strict, struct(none, empty))
        .when(field == "NEW_CLUSTER", struct(none, F.coalesce(told_by("title", r'[^"]*'), empty)))
        .when(field.isNotNull() & (told >= least), struct(field, empty))
        .when(field.isNotNull(), struct(none, empty))
        .when(lead.isNotNull(), struct(lead, empty))
        .otherwise(struct(none, F.trim(F.regexp_extract(r, r'(?i)^NEW_CLUSTER\s*[:\-]\s*"(.*)"', 1))))
    )
