"""The library's logger; quiet unless the application configures logging or sets one."""

from __future__ import annotations

import logging
from typing import Protocol


class Logger(Protocol):
    def debug(self, msg: str, *args: object) -> None: ...
    def info(self, msg: str, *args: object) -> None: ...
    def warning(self, msg: str, *args: object) -> None: ...
    def error(self, msg: str, *args: object) -> None: ...


_default = logging.getLogger("docquarry")
_default.addHandler(logging.NullHandler())
_current: Logger = _default


def logger() -> Logger:
    return _current


def set_logger(new: Logger | None) -> None:
    """Use another logger; None: the default one."""
    global _current
    _current = _default if new is None else new
