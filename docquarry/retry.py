"""Retry with exponential backoff and jitter."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TypeVar

from .errors import AbortError, ValidationError, is_retryable

T = TypeVar("T")


@dataclass
class RetryMetrics:
    attempts: int = 0
    retries: int = 0
    succeeded: bool = False
    delays: list[float] = field(default_factory=list)
    errors: list[BaseException] = field(default_factory=list)


@dataclass(frozen=True)
class RetryPolicy:
    """``max_retries`` after the first attempt; delays in seconds: ``base * factor**n``, at most ``cap``, spread by ``jitter``."""

    max_retries: int = 3
    base: float = 0.1
    factor: float = 2.0
    jitter: float = 0.5
    cap: float = 10.0

    def __post_init__(self):
        if self.max_retries < 0 or self.base < 0 or self.factor < 1 or not 0 <= self.jitter <= 1 or self.cap < 0:
            raise ValidationError("invalid retry policy")

    def delay(self, retry: int, rng: Callable[[], float] = random.random) -> float:
        plain = min(self.cap, self.base * self.factor**retry)
        return min(self.cap, max(0.0, plain * (1 + self.jitter * (2 * rng() - 1))))


def with_retry(
    work: Callable[[], T],
    policy: RetryPolicy = RetryPolicy(),
    *,
    should_retry: Callable[[BaseException], bool] = is_retryable,
    on_retry: Callable[[BaseException, int, float], bool | None] | None = None,
    on_success: Callable[[RetryMetrics], None] | None = None,
    on_failure: Callable[[BaseException, RetryMetrics], None] | None = None,
    aborted: Callable[[], bool] = lambda: False,
    sleep: Callable[[float], None] = time.sleep,
    metrics: RetryMetrics | None = None,
) -> T:
    """Run ``work`` until it succeeds, fails for good, or retries run out. ``on_retry`` may return False to stop."""
    m = metrics or RetryMetrics()
    while True:
        if aborted():
            raise AbortError("the operation was aborted")
        m.attempts += 1
        try:
            result = work()
        except Exception as error:
            m.errors.append(error)
            stop = m.retries >= policy.max_retries or not should_retry(error)
            delay = policy.delay(m.retries)
            if stop or (on_retry is not None and on_retry(error, m.retries + 1, delay) is False):
                if on_failure is not None:
                    on_failure(error, m)
                raise
            m.retries += 1
            m.delays.append(delay)
            sleep(delay)
            continue
        m.succeeded = True
        if on_success is not None:
            on_success(m)
        return result
