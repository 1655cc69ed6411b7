"""Driver-side guards for calls to outside services, and the settings that pipelines take."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps
from hashlib import md5
from typing import Any

from granary.operators.governance import BREAKERS, Breaker


class Rejected(RuntimeError):
    """A call that an open breaker didn't let through."""


def guarded(service: str = "llm", fallback: Callable[..., Any] | None = None, breaker: Breaker | None = None, clock: Callable[[], float] = time.time) -> Callable:
    """Decorator: calls go through a circuit breaker; while it is open ``fallback`` answers, or Rejected is raised. A failing call raises its own error."""
    own = breaker or Breaker(*BREAKERS[service])

    def wrap(fn: Callable) -> Callable:
        @wraps(fn)
        def run(*args: Any, **named: Any) -> Any:
            now = clock()
            if not own.lets(now):
                if fallback:
                    return fallback(*args, **named)
                raise Rejected(service)
            try:
                out = fn(*args, **named)
            except Exception:
                own.call(now, False)
                raise
            own.call(now, True)
            return out

        run.breaker = own
        return run

    return wrap


class Cache:
    """Values by key for ``ttl`` seconds: a hit if no older than that. 0 means 3600."""

    def __init__(self, ttl: float = 3600.0, clock: Callable[[], float] = time.time) -> None:
        self.ttl, self.clock, self.held = ttl or 3600.0, clock, {}

    def get(self, key: str) -> Any:
        value, at, ttl = self.held.get(key, (None, 0.0, -1.0))
        if ttl >= 0 and self.clock() - at <= ttl:
            return value
        self.held.pop(key, None)
        return None

    def set(self, key: str, value: Any, ttl: float | None = None) -> None:
        self.held[key] = (value, self.clock(), ttl or self.ttl)

    def delete(self, key: str) -> None:
        self.held.pop(key, None)

    def clear(self) -> None:
        self.held.clear()

    def stats(self) -> dict[str, int]:
        valid = sum(self.clock() - at <= ttl for _, at, ttl in self.held.values())
        return {"total": len(self.held), "valid": valid, "expired": len(self.held) - valid}


def key_of(*args: Any, **named: Any) -> str:
    """MD5 of the arguments and the sorted name=value pairs, joined by bars."""
    return md5("|".join([*map(str, args), *(f"{k}={v}" for k, v in sorted(named.items()))]).encode()).hexdigest()


def cached(cache: Cache, prefix: str = "") -> Callable:
    """Decorator: results by function and arguments; None isn't kept."""

    def wrap(fn: Callable) -> Callable:
        @wraps(fn)
        def run(*args: Any, **named: Any) -> Any:
            key = key_of(prefix or fn.__name__, *args, **named)
            value = cache.get(key)
            if value is None and (value := fn(*args, **named)) is not None:
                cache.set(key, value)
            return value

        return run

    return wrap


@dataclass(frozen=True)
class Settings:
    """Defaults of the pipelines, passed on explicitly."""

    chunk_tokens: int = 1000
    chunk_overlap: int = 100
    top_k: int = 5
    vector_weight: float = 0.7
    lexical_weight: float = 0.3
    context_tokens: int = 3000
    dedupe_threshold: float = 0.85
    near_threshold: float = 0.95
    cache_ttl: float = 3600.0
    embedding_model: str = "hashing"
    embedding_version: str = "1"
