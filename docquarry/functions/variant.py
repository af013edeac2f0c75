"""Variant values: JSON-like documents in Spark's binary form."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import VariantVal


def encode(value: object) -> VariantVal:
    """A Python value as a variant (metadata and value bytes)."""
    return VariantVal.parseJson(json.dumps(value, default=str))


def decode(value: VariantVal) -> object:
    return value.toPython()


def encode_json(text: Column) -> Column:
    """JSON text as a variant; null where it isn't JSON."""
    return F.try_parse_json(text)


def decode_json(value: Column) -> Column:
    return F.to_json(value)


def shred(value: Column, fields: dict[str, str]) -> list[Column]:
    """Typed columns of some paths: null where a document lacks the path or holds another kind."""
    return [F.try_variant_get(value, f"$.{path}", kind).alias(path.replace(".", "_")) for path, kind in fields.items()]
