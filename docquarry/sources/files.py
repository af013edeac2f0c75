"""Single files on the driver: Parquet from bytes, and change files of either format."""

from __future__ import annotations

import datetime as dt
import io
import json

import pyarrow.parquet as pq

from ..errors import CDCError, ValidationError

PARQUET_MAGIC = b"PAR1"


def is_parquet(data: bytes) -> bool:
    return len(data) >= 12 and data[:4] == PARQUET_MAGIC and data[-4:] == PARQUET_MAGIC


def read_parquet_bytes(data: bytes, columns: list[str] | None = None) -> list[dict]:
    """Documents of a Parquet file in memory. For small files; Spark reads tables."""
    if not is_parquet(data):
        raise ValidationError("not a Parquet file", "data", data[:4])
    return pq.read_table(io.BytesIO(data), columns=columns).to_pylist()


def _revive(value: object) -> object:
    """JSON objects ``{"$date": ms}`` and ``{"$bigint": "digits"}`` are dates and integers."""
    if isinstance(value, dict):
        if set(value) == {"$date"}:
            return dt.datetime.fromtimestamp(value["$date"] / 1000, dt.UTC).replace(tzinfo=None)
        if set(value) == {"$bigint"}:
            return int(value["$bigint"])
        return {k: _revive(v) for k, v in value.items()}
    return [_revive(v) for v in value] if isinstance(value, list) else value


def read_change_file(data: bytes) -> list[dict]:
    """Change rows of a Parquet file, or of a JSON array or JSON lines."""
    if is_parquet(data):
        return read_parquet_bytes(data)
    try:
        text = data.decode()
        rows = json.loads(text) if text.lstrip().startswith("[") else [json.loads(x) for x in text.splitlines() if x.strip()]
    except ValueError as e:
        raise CDCError("a change file is neither Parquet nor JSON", "PARSE_ERROR") from e
    return [_revive(r) for r in rows]
