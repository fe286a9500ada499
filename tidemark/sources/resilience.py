"""Retries, circuit breaking and rate limits around calls that are not Spark's."""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field


class CircuitOpenError(RuntimeError):
    """The breaker is open; the call was not made."""


class RateLimitedError(RuntimeError):
    """No token is left and the limiter drops calls."""


@dataclass
class Retry:
    """Up to ``tries`` calls with exponential waits of +-``jitter``."""

    tries: int = 3
    first_wait: float = 1.0
    factor: float = 2.0
    jitter: float = 0.1
    most_wait: float = 60.0
    on: tuple[type[BaseException], ...] = (ConnectionError, TimeoutError, OSError)
    sleep: Callable[[float], None] = time.sleep

    def call(self, f: Callable, *args, **kwargs):
        for n in range(self.tries):
            try:
                return f(*args, **kwargs)
            except self.on:
                if n + 1 == self.tries:
                    raise
                wait = min(self.most_wait, self.first_wait * self.factor**n)
                self.sleep(wait * (1 + self.jitter * random.uniform(-1, 1)))


@dataclass
class CircuitBreaker:
    """Opens after ``failures`` in a row, lets one call through after ``pause`` seconds, closes after ``successes``."""

    failures: int = 5
    pause: float = 60.0
    successes: int = 2
    clock: Callable[[], float] = time.monotonic
    state: str = "closed"
    _failed: int = 0
    _good: int = 0
    _since: float = 0.0
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def call(self, f: Callable, *args, **kwargs):
        with self._lock:
            if self.state == "open":
                if self.clock() - self._since < self.pause:
                    raise CircuitOpenError("circuit is open")
                self.state, self._good = "half_open", 0
        try:
            out = f(*args, **kwargs)
        except BaseException:
            with self._lock:
                self._failed += 1
                if self.state == "half_open" or self._failed >= self.failures:
                    self.state, self._since = "open", self.clock()
            raise
        with self._lock:
            self._failed, self._good = 0, self._good + 1
            if self.state == "half_open" and self._good >= self.successes:
                self.state = "closed"
        return out


@dataclass
class RateLimiter:
    """A token bucket: ``per_minute`` calls on average, ``burst`` at once; waits or drops."""

    per_minute: float = 60.0
    burst: int = 10
    policy: str = "wait"
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    _tokens: float | None = None
    _at: float = 0.0

    def acquire(self) -> None:
        now = self.clock()
        self._tokens = self.burst if self._tokens is None else min(self.burst, self._tokens + (now - self._at) * self.per_minute / 60)
        self._at = now
        if self._tokens < 1:
            if self.policy == "drop":
                raise RateLimitedError("rate limit reached")
            self.sleep((1 - self._tokens) * 60 / self.per_minute)
            self._tokens, self._at = 1.0, self.clock()
        self._tokens -= 1
