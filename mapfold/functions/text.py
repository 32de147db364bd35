"""Text helpers: RDF literals, JSON strings, request parameters."""

from __future__ import annotations

from urllib.parse import parse_qsl

from pyspark.sql import Column
from pyspark.sql import functions as F


def shown(value: Column) -> Column:
    """A value as a result table shows it: without datatype or language, quotes off; --- for null."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(value, r'(\^\^\S+|@[A-Za-z][A-Za-z-]*)$', ""), r'^"|"$', ""), F.lit("---"))


def json_string(value: Column) -> Column:
    """A JSON string literal, null for null."""
    wrapped = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNotNull(), F.regexp_extract(wrapped, r'(?s)^\{"v":(.*)\}$', 1))


def number(value: Column, digits: int = 6) -> Column:
    """A number with fixed decimals, as text."""
    return F.round(value, digits).cast(f"decimal(30,{digits})").cast("string")


def hidden_columns(columns: list[str]) -> list[str]:
    """Columns a result table leaves out: the geometry (last), images and flags."""
    return [c for i, c in enumerate(columns) if i == len(columns) - 1 or c in ("image", "flag") or c.endswith("_image")]


def params(query: str, body: str = "") -> dict[str, str]:
    """Request parameters of a query string and a form body; the body's win."""
    return dict(parse_qsl(query, keep_blank_values=True)) | dict(parse_qsl(body, keep_blank_values=True))
