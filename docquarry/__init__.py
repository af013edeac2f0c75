"""Document lakehouse on Spark: document filters, projections and pipelines over versioned Parquet tables."""

from .errors import CDCError, ConcurrencyError, DocQuarryError, FileNotFoundInStorage, StorageError, ValidationError, VersionMismatchError
from .operators.filters import compile_filter, find, get_nested_value, validate_filter
from .operators.pipeline import aggregate, aggregate_with_stats
from .operators.projection import project
from .retry import RetryPolicy, with_retry
from .sources.log import CheckpointPolicy, Snapshot
from .sources.maintenance import cluster, compact, deduplicate, vacuum
from .sources.storage import open_storage
from .sources.table import Table
from .sources.writer import PartsWriter
from .streaming.changes import ChangeTable
from .streaming.envelope import Consumer, ConsumerConfig, Offsets, Producer, Source

__all__ = [
    "CDCError",
    "ChangeTable",
    "CheckpointPolicy",
    "ConcurrencyError",
    "Consumer",
    "ConsumerConfig",
    "DocQuarryError",
    "FileNotFoundInStorage",
    "Offsets",
    "PartsWriter",
    "Producer",
    "RetryPolicy",
    "Snapshot",
    "Source",
    "StorageError",
    "Table",
    "ValidationError",
    "VersionMismatchError",
    "aggregate",
    "aggregate_with_stats",
    "cluster",
    "compact",
    "compile_filter",
    "deduplicate",
    "find",
    "get_nested_value",
    "open_storage",
    "project",
    "vacuum",
    "validate_filter",
    "with_retry",
]
