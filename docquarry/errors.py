"""Error hierarchy. Every error has a ``code`` and tells whether a retry can help."""

from __future__ import annotations


class DocQuarryError(Exception):
    code = "ERROR"
    retryable = False

    def __init__(self, message: str, *, code: str | None = None):
        super().__init__(message)
        if code is not None:
            self.code = code


class ValidationError(DocQuarryError):
    """Bad input: a filter, a row, an option or an action. ``field`` and ``value`` name the culprit."""

    code = "VALIDATION_ERROR"

    def __init__(self, message: str, field: str | None = None, value: object = None):
        super().__init__(message)
        self.field, self.value = field, value


class StorageError(DocQuarryError):
    code = "STORAGE_ERROR"

    def __init__(self, message: str, path: str | None = None, operation: str | None = None):
        super().__init__(message)
        self.path, self.operation = path, operation


class FileNotFoundInStorage(StorageError):
    code = "FILE_NOT_FOUND"


class VersionMismatchError(StorageError):
    """A conditional write found another version of the file than expected."""

    code = "VERSION_MISMATCH"

    def __init__(self, path: str, expected: str | None, actual: str | None):
        super().__init__(f"{path}: expected version {expected}, found {actual}", path, "write_conditional")
        self.expected, self.actual = expected, actual


class ConcurrencyError(DocQuarryError):
    """Another writer has committed first."""

    code = "CONCURRENCY_ERROR"
    retryable = True

    def __init__(self, message: str, expected: int | None = None, actual: int | None = None):
        super().__init__(message)
        self.expected, self.actual = expected, actual


class AbortError(DocQuarryError):
    code = "ABORTED"


#: Codes of change-feed errors.
CDC_CODES = (
    "INVALID_VERSION_RANGE",
    "INVALID_TIME_RANGE",
    "TABLE_NOT_FOUND",
    "CDC_NOT_ENABLED",
    "STORAGE_ERROR",
    "PARSE_ERROR",
    "EMPTY_WRITE",
    "INVALID_CONSUMER_CONFIG",
    "OFFSET_COMMIT_FAILED",
)


class CDCError(DocQuarryError):
    def __init__(self, message: str, code: str):
        if code not in CDC_CODES:
            raise ValueError(f"unknown code {code}")
        super().__init__(message, code=code)


def is_retryable(error: BaseException) -> bool:
    return bool(getattr(error, "retryable", False))
