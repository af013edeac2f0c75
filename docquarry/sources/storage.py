"""Small-file storage for logs, offsets and deletion vectors. Data files are read and written by Spark alone.

``LocalStorage`` for file paths, ``HadoopStorage`` for every scheme that the session's Hadoop knows (hdfs, s3a, ...), and
``MemoryStorage`` for tests. ``create`` is put-if-absent: the point at which concurrent commits are put in order.
"""

from __future__ import annotations

import os
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import unquote, urlparse

from ..errors import FileNotFoundInStorage, StorageError, ValidationError, VersionMismatchError


@dataclass(frozen=True)
class FileStat:
    size: int
    modified_ms: int


class Storage:
    """Paths are relative, with '/'. ``version`` is an opaque mark of a file's state, None if there is no file."""

    def read(self, path: str) -> bytes: ...
    def write(self, path: str, data: bytes) -> None: ...
    def create(self, path: str, data: bytes) -> None:
        """Write a file that must not exist yet; VersionMismatchError if it does."""

    def list(self, prefix: str) -> list[str]:
        """Files under a directory, sorted."""

    def delete(self, path: str) -> None:
        """Remove a file or folder; no error if it is missing."""

    def exists(self, path: str) -> bool: ...
    def stat(self, path: str) -> FileStat | None: ...
    def version(self, path: str) -> str | None: ...

    def read_range(self, path: str, start: int, end: int) -> bytes:
        if start < 0 or end < start:
            raise ValidationError("a range is 0 <= start <= end", path, (start, end))
        return self.read(path)[start:end]

    def write_conditional(self, path: str, data: bytes, expected: str | None) -> str:
        """Write if the file is still at ``expected`` (None: absent); the new version."""
        if expected is None:
            self.create(path, data)
        else:
            with path_lock(f"{id(type(self))}/{path}"):
                found = self.version(path)
                if found != expected:
                    raise VersionMismatchError(path, expected, found)
                self.write(path, data)
        return self.version(path) or ""

    def open_range(self, path: str) -> RangedFile:
        return RangedFile(self, path)


class RangedFile:
    """A file by its length and slices of it."""

    def __init__(self, storage: Storage, path: str):
        found = storage.stat(path)
        if found is None:
            raise FileNotFoundInStorage(f"{path} does not exist", path, "stat")
        self.storage, self.path, self.byte_length = storage, path, found.size

    def slice(self, start: int, end: int | None = None) -> bytes:
        return self.storage.read_range(self.path, start, self.byte_length if end is None else min(end, self.byte_length))


_locks: dict[str, threading.Lock] = {}
_guard = threading.Lock()


@contextmanager
def path_lock(path: str) -> Iterator[None]:
    """Serialises writers of one path in this process."""
    with _guard:
        lock = _locks.setdefault(path, threading.Lock())
    with lock:
        yield


def safe_path(path: str) -> str:
    """A relative path without '..' or NUL."""
    if "\0" in path or any(p == ".." for p in path.split("/")):
        raise ValidationError("a path may not leave its root", "path", path)
    return path.strip("/")


class LocalStorage(Storage):
    def __init__(self, root: str):
        self.root = Path(root)

    def _at(self, path: str) -> Path:
        return self.root / safe_path(path)

    def read(self, path: str) -> bytes:
        try:
            return self._at(path).read_bytes()
        except FileNotFoundError as e:
            raise FileNotFoundInStorage(f"{path} does not exist", path, "read") from e

    def _temp(self, path: str, data: bytes) -> tuple[Path, Path]:
        to = self._at(path)
        to.parent.mkdir(parents=True, exist_ok=True)
        temp = to.with_name(f".{to.name}.{uuid.uuid4().hex}.tmp")
        temp.write_bytes(data)
        return temp, to

    def write(self, path: str, data: bytes) -> None:
        temp, to = self._temp(path, data)
        os.replace(temp, to)

    def create(self, path: str, data: bytes) -> None:
        temp, to = self._temp(path, data)
        try:
            os.link(temp, to)  # whole or not at all, and only if absent: holds across processes
        except FileExistsError as e:
            raise VersionMismatchError(path, None, self.version(path)) from e
        finally:
            temp.unlink()

    def list(self, prefix: str) -> list[str]:
        top = self._at(prefix)
        return sorted(str(p.relative_to(self.root)) for p in top.rglob("*") if p.is_file() and not p.name.endswith(".crc") and not p.name.startswith(".")) if top.is_dir() else []

    def delete(self, path: str) -> None:
        at = self._at(path)
        if at.is_dir():
            for p in sorted(at.rglob("*"), reverse=True):
                p.rmdir() if p.is_dir() else p.unlink()
            at.rmdir()
        else:
            at.unlink(missing_ok=True)
            at.with_name(f".{at.name}.crc").unlink(missing_ok=True)

    def exists(self, path: str) -> bool:
        return self._at(path).exists()

    def stat(self, path: str) -> FileStat | None:
        try:
            s = self._at(path).stat()
        except FileNotFoundError:
            return None
        return FileStat(s.st_size, s.st_mtime_ns // 1_000_000)

    def version(self, path: str) -> str | None:
        try:
            return str(self._at(path).stat().st_mtime_ns)
        except FileNotFoundError:
            return None

    def read_range(self, path: str, start: int, end: int) -> bytes:
        if start < 0 or end < start:
            raise ValidationError("a range is 0 <= start <= end", path, (start, end))
        with self._at(path).open("rb") as f:
            f.seek(start)
            return f.read(end - start)


class HadoopStorage(Storage):
    """Through the session's JVM. ``create`` never overwrites; how atomic that is depends on the file system."""

    def __init__(self, spark, root: str):
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{safe_path(path)}" if path else self.root)

    def read(self, path: str) -> bytes:
        if not self.exists(path):
            raise FileNotFoundInStorage(f"{path} does not exist", path, "read")
        stream = self.fs.open(self._path(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def _put(self, path: str, data: bytes, overwrite: bool) -> None:
        stream = self.fs.create(self._path(path), overwrite)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def write(self, path: str, data: bytes) -> None:
        self._put(path, data, True)

    def create(self, path: str, data: bytes) -> None:
        if self.exists(path):
            raise VersionMismatchError(path, None, self.version(path))
        temp = f"{path}.{uuid.uuid4().hex}.tmp"
        self._put(temp, data, False)
        try:
            if not self.fs.rename(self._path(temp), self._path(path)):
                raise VersionMismatchError(path, None, self.version(path))
        finally:
            self.delete(temp)

    def list(self, prefix: str) -> list[str]:
        top = self._path(prefix)
        if not self.fs.exists(top):
            return []
        out, found = [], self.fs.listFiles(top, True)
        base = self.fs.makeQualified(self._path("")).toString()
        while found.hasNext():
            out.append(found.next().getPath().toString().removeprefix(base).lstrip("/"))
        return sorted(p for p in out if not p.rsplit("/", 1)[-1].startswith("."))

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def stat(self, path: str) -> FileStat | None:
        if not self.exists(path):
            return None
        s = self.fs.getFileStatus(self._path(path))
        return FileStat(s.getLen(), s.getModificationTime())

    def version(self, path: str) -> str | None:
        s = self.stat(path)
        return None if s is None else f"{s.modified_ms}-{s.size}"


@dataclass
class MemoryStorage(Storage):
    """For tests: ``latency`` in seconds per call, ``capacity`` in bytes, ``history`` of calls, snapshots."""

    latency: float = 0.0
    capacity: int | None = None
    files: dict[str, tuple[bytes, int, int]] = field(default_factory=dict)  # data, version, modified_ms
    history: list[tuple[str, str]] = field(default_factory=list)
    fail: Callable[[str, str], None] | None = None

    def _log(self, op: str, path: str) -> str:
        if self.latency:
            time.sleep(self.latency)
        path = safe_path(path)
        self.history.append((op, path))
        if self.fail is not None:
            self.fail(op, path)
        return path

    def _set(self, path: str, data: bytes) -> None:
        held = sum(len(d) for p, (d, _, _) in self.files.items() if p != path)
        if self.capacity is not None and held + len(data) > self.capacity:
            raise StorageError("the storage is full", path, "write")
        self.files[path] = (bytes(data), self.files.get(path, (b"", 0, 0))[1] + 1, int(time.time() * 1000))

    def read(self, path: str) -> bytes:
        path = self._log("read", path)
        if path not in self.files:
            raise FileNotFoundInStorage(f"{path} does not exist", path, "read")
        return self.files[path][0]

    def write(self, path: str, data: bytes) -> None:
        self._set(self._log("write", path), data)

    def create(self, path: str, data: bytes) -> None:
        path = self._log("create", path)
        with path_lock(f"memory/{id(self)}/{path}"):
            if path in self.files:
                raise VersionMismatchError(path, None, str(self.files[path][1]))
            self._set(path, data)

    def list(self, prefix: str) -> list[str]:
        prefix = self._log("list", prefix)
        return sorted(p for p in self.files if not prefix or p.startswith(f"{prefix}/"))

    def delete(self, path: str) -> None:
        path = self._log("delete", path)
        for p in [p for p in self.files if p == path or p.startswith(f"{path}/")]:
            del self.files[p]

    def exists(self, path: str) -> bool:
        path = self._log("exists", path)
        return path in self.files

    def stat(self, path: str) -> FileStat | None:
        found = self.files.get(self._log("stat", path))
        return None if found is None else FileStat(len(found[0]), found[2])

    def version(self, path: str) -> str | None:
        found = self.files.get(safe_path(path))
        return None if found is None else str(found[1])

    def snapshot(self) -> dict:
        return dict(self.files)

    def restore(self, state: dict) -> None:
        self.files = dict(state)


@dataclass(frozen=True)
class Location:
    """A parsed storage URL. ``uri`` is what Spark reads and writes."""

    scheme: str
    uri: str
    bucket: str | None = None
    key: str = ""
    region: str | None = None


_S3_HOST = re.compile(r"^(?:(?P<bucket>[^.]+)\.)?s3[.-](?:(?P<region>[a-z0-9-]+)\.)?amazonaws\.com$")


def parse_location(url: str) -> Location:
    """``memory://``, ``file://`` and plain paths, ``s3://`` / ``s3a://`` / ``r2://`` buckets, S3 web addresses, and any
    other scheme as it is."""
    if not isinstance(url, str) or not url:
        raise ValidationError("a location is a non-empty string", "url", url)
    parts = urlparse(url)
    if parts.scheme in ("", "file"):
        path = unquote(parts.path) if parts.scheme else url
        if "\0" in path:
            raise ValidationError("a path may not hold NUL", "url", url)
        return Location("file", str(Path(path).absolute()))
    if parts.scheme == "memory":
        return Location("memory", url, key=f"{parts.netloc}{parts.path}".strip("/"))
    if parts.scheme in ("http", "https") and (m := _S3_HOST.match(parts.netloc)):
        bucket, _, key = (m["bucket"], "", parts.path.strip("/")) if m["bucket"] else parts.path.strip("/").partition("/")
        return Location("s3", f"s3a://{bucket}/{key}", bucket, key, m["region"])
    if parts.scheme in ("s3", "s3a", "s3n", "r2"):
        if not parts.netloc:
            raise ValidationError("the location lacks a bucket", "url", url)
        key = parts.path.strip("/")
        return Location("r2" if parts.scheme == "r2" else "s3", f"s3a://{parts.netloc}/{key}", parts.netloc, key)
    if parts.scheme in ("http", "https"):
        raise ValidationError("unsupported location", "url", url)
    return Location(parts.scheme, url)


def open_storage(url: str, spark=None) -> Storage:
    at = parse_location(url)
    if at.scheme == "file":
        return LocalStorage(at.uri)
    if at.scheme == "memory":
        return MemoryStorage()
    if spark is None:
        raise ValidationError(f"{at.scheme} needs a Spark session", "url", url)
    return HadoopStorage(spark, at.uri)
