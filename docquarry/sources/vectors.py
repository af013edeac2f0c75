"""Deletion vectors: 64-bit roaring bitmaps of row ordinals, inline (Z85) or in files."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Mapping

import numpy as np

from ..errors import ValidationError
from .storage import Storage

#: Fixed value: the Z85 alphabet.
Z85 = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.-:+=^!/*?&<>()[]{}@%$#"
_DIGIT = {c: i for i, c in enumerate(Z85)}
#: Fixed values of the 64-bit roaring format.
MAGIC = 1681511377
COOKIE, COOKIE_NO_RUNS, NO_OFFSETS_BELOW = 12347, 12346, 4


def z85_decode(text: str) -> bytes:
    if len(text) % 5:
        raise ValidationError("Z85 text comes in groups of five characters", "z85", text)
    out = bytearray()
    for at in range(0, len(text), 5):
        value = 0
        for c in text[at : at + 5]:
            if c not in _DIGIT:
                raise ValidationError(f"{c!r} is not a Z85 character", "z85", text)
            value = value * 85 + _DIGIT[c]
        if value >> 32:
            raise ValidationError("a Z85 group exceeds 32 bits", "z85", text)
        out += value.to_bytes(4, "big")
    return bytes(out)


def z85_encode(data: bytes) -> str:
    data += b"\0" * (-len(data) % 4)
    out = []
    for at in range(0, len(data), 4):
        value = int.from_bytes(data[at : at + 4], "big")
        digits = []
        for _ in range(5):
            value, d = divmod(value, 85)
            digits.append(Z85[d])
        out += reversed(digits)
    return "".join(out)


def z85_decode_uuid(text: str) -> uuid.UUID:
    """The UUID at the end of a relative vector's name; what stands before is a folder prefix."""
    return uuid.UUID(bytes=z85_decode(text[-20:]))


def vector_path(descriptor: Mapping) -> str | None:
    """Where the vector lies: relative to the table, absolute, or None for inline ones."""
    kind, name = descriptor["storageType"], descriptor["pathOrInlineDv"]
    if kind == "i":
        return None
    if kind == "p":
        return name
    if kind == "u":
        prefix = name[:-20]
        return f"{prefix + '/' if prefix else ''}deletion_vector_{z85_decode_uuid(name)}.bin"
    raise ValidationError(f"unknown vector storage {kind}", "storageType", kind)


def parse_roaring32(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """Values of one 32-bit bitmap and the position after it."""
    try:
        (cookie,) = struct.unpack_from("<I", data, at)
        at += 4
        if cookie & 0xFFFF == COOKIE:
            n = (cookie >> 16) + 1
            runs = [bool(data[at + i // 8] >> (i % 8) & 1) for i in range(n)]
            at += (n + 7) // 8
        elif cookie == COOKIE_NO_RUNS:
            (n,) = struct.unpack_from("<I", data, at)
            at += 4
            runs = [False] * n
        else:
            raise ValidationError("not a roaring bitmap", "cookie", cookie)
        heads = np.frombuffer(data, "<u2", 2 * n, at).reshape(n, 2)
        at += 4 * n
        if cookie == COOKIE_NO_RUNS or n >= NO_OFFSETS_BELOW:
            at += 4 * n
        parts = []
        for (key, less_one), run in zip(heads.tolist(), runs, strict=True):
            if run:
                (count,) = struct.unpack_from("<H", data, at)
                pairs = np.frombuffer(data, "<u2", 2 * count, at + 2).reshape(count, 2).astype(np.int64)
                at += 2 + 4 * count
                low = np.concatenate([np.arange(s, s + length + 1) for s, length in pairs]) if count else np.empty(0, np.int64)
            elif less_one + 1 > 4096:
                low = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, 8192, at), bitorder="little"))
                at += 8192
            else:
                low = np.frombuffer(data, "<u2", less_one + 1, at).astype(np.int64)
                at += 2 * (less_one + 1)
            parts.append((key << 16) + low.astype(np.int64))
    except (struct.error, ValueError, IndexError) as e:
        raise ValidationError("a roaring bitmap is cut short", "vector", len(data)) from e
    return (np.concatenate(parts) if parts else np.empty(0, np.int64)), at


def parse_roaring(data: bytes) -> np.ndarray:
    """Values of a 64-bit bitmap: magic number, count, then (high half, 32-bit bitmap) pairs."""
    if len(data) < 12 or struct.unpack_from("<I", data)[0] != MAGIC:
        raise ValidationError("a deletion vector starts with its magic number", "vector", data[:4])
    (n,) = struct.unpack_from("<Q", data, 4)
    at, parts = 12, []
    for _ in range(n):
        (high,) = struct.unpack_from("<I", data, at)
        low, at = parse_roaring32(data, at + 4)
        parts.append((high << 32) + low)
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def build_roaring(rows: np.ndarray) -> bytes:
    """A 64-bit bitmap of sorted distinct values, in array and bitset containers."""
    rows = np.unique(np.asarray(rows, np.int64))
    highs = np.unique(rows >> 32)
    out = struct.pack("<IQ", MAGIC, len(highs))
    for high in highs:
        low = rows[rows >> 32 == high] & 0xFFFFFFFF
        keys = np.unique(low >> 16)
        bodies, heads = [], b""
        for key in keys:
            part = (low[low >> 16 == key] & 0xFFFF).astype("<u2")
            heads += struct.pack("<HH", key, len(part) - 1)
            if len(part) > 4096:
                bits = np.zeros(65536, np.uint8)
                bits[part] = 1
                bodies.append(np.packbits(bits, bitorder="little").tobytes())
            else:
                bodies.append(part.tobytes())
        start = 8 + len(heads) + 4 * len(keys)
        offsets = np.cumsum([start] + [len(b) for b in bodies[:-1]]).astype("<u4").tobytes() if len(keys) else b""
        out += struct.pack("<I", high) + struct.pack("<II", COOKIE_NO_RUNS, len(keys)) + heads + offsets + b"".join(bodies)
    return out


def inline_vector(rows: np.ndarray) -> dict:
    """A descriptor that holds the vector itself."""
    data = build_roaring(rows)
    return {"storageType": "i", "pathOrInlineDv": z85_encode(data), "sizeInBytes": len(data), "cardinality": int(len(np.unique(rows)))}


def vector_bytes(storage: Storage, descriptor: Mapping) -> bytes:
    """The bitmap of a descriptor. Fails if it can't be read: rows must not come back."""
    path = vector_path(descriptor)
    size = int(descriptor["sizeInBytes"])
    if path is None:
        return z85_decode(descriptor["pathOrInlineDv"])[:size]
    start = int(descriptor.get("offset") or 0)
    head = storage.read_range(path, start, start + 4)
    if int.from_bytes(head, "big") != size:
        raise ValidationError("the deletion vector's size doesn't match its descriptor", "sizeInBytes", size)
    return storage.read_range(path, start + 4, start + 4 + size)


def parse_vector(data: bytes, cardinality: int | None = None) -> np.ndarray:
    rows = parse_roaring(data)
    if cardinality is not None and len(rows) != cardinality:
        raise ValidationError("the deletion vector's cardinality doesn't match its descriptor", "cardinality", len(rows))
    return rows


def load_vector(storage: Storage, descriptor: Mapping) -> np.ndarray:
    """Row ordinals that a descriptor deletes."""
    n = descriptor.get("cardinality")
    return parse_vector(vector_bytes(storage, descriptor), None if n is None else int(n))
