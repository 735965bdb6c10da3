"""Retries and refusals of a remote source; transport is the caller's."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from quire.control.pool import MailtoPool


class SourceError(Exception):
    """``exit_code``: what a command ends with."""

    exit_code = 6


class NotFound(SourceError):
    exit_code = 2


class Unauthorised(SourceError):
    exit_code = 3


class RateLimited(SourceError):
    exit_code = 4

    def __init__(self, message: str, retry_after: float | None = None):
        super().__init__(message)
        self.retry_after = retry_after


@dataclass(frozen=True)
class Response:
    status: int
    body: Any = None
    retry_after: float | None = None


def request(send: Callable[[], Response], retries: int = 3, pause: Callable[[float], None] = time.sleep, longest_wait: float = 60.0) -> Any:
    """The body of the first success.

    404 and refused credentials are final; 429 is for the caller to rotate;
    server errors and lost connections are tried again with growing pauses of
    at most 8 seconds, or as long as the server asks (at most ``longest_wait``).
    """
    last = "no attempt"
    for attempt in range(retries):
        wait = min(2.0**attempt, 8.0)
        try:
            got = send()
        except OSError as e:
            last = str(e)
        else:
            if got.status < 400:
                return got.body
            if got.status == 404:
                raise NotFound("not found")
            if got.status in (401, 403):
                raise Unauthorised(f"status {got.status}")
            if got.status == 429:
                raise RateLimited("too many requests", got.retry_after)
            if got.status < 500:
                raise SourceError(f"status {got.status}")
            last, wait = f"status {got.status}", min(got.retry_after or wait, longest_wait)
        if attempt + 1 < retries:
            pause(wait)
    raise SourceError(f"gave up after {retries} attempts: {last}")


def rotating(pool: MailtoPool, send: Callable[[str | None], Response], rotations: int = 3, pause: Callable[[float], None] = time.sleep) -> Any:
    """``request`` under one address after the other: a refused address rests, the next one tries."""
    for attempt in range(rotations + 1):
        mailto = pool.next()
        try:
            body = request(lambda m=mailto: send(m), pause=pause)
        except RateLimited as e:
            if mailto:
                pool.mark_rate_limited(mailto, e.retry_after)
            if attempt == rotations:
                raise
            pause(1.0)
        else:
            if mailto:
                pool.mark_ok(mailto)
            return body
    raise AssertionError("unreachable")
