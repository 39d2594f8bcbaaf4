"""Guards of the driver: names, paths, and failing services."""

from __future__ import annotations

import fcntl
import os
import re
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import PurePosixPath

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_\-]*")
FAILURES, RESET_S = 5, 60.0


def store_name(name: str) -> str:
    """The name of a store, or an error for anything that could be more than a name."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a name: {name!r}")
    return name


def inside(root: str, path: str) -> str:
    """``path`` under ``root``; a path that leaves it is refused."""
    parts: list[str] = []
    for part in PurePosixPath(path).parts:
        if part == "/" or (part == ".." and not parts):
            raise ValueError(f"outside of {root}: {path!r}")
        parts.pop() if part == ".." else parts.append(part)
    return "/".join([root.rstrip("/"), *parts])


class Breaker:
    """Refuses calls for a while after several failures in a row, then starts afresh."""

    def __init__(self, failures: int = FAILURES, reset: float = RESET_S, clock: Callable[[], float] = time.monotonic):
        self.failures, self.reset, self.clock = failures, reset, clock
        self.count, self.since = 0, 0.0

    def open(self) -> bool:
        if self.count >= self.failures and self.clock() - self.since >= self.reset:
            self.count = 0
        return self.count >= self.failures

    def record(self, success: bool) -> None:
        self.count, self.since = (0, self.since) if success else (self.count + 1, self.clock())

    def call(self, f: Callable, *args):
        if self.open():
            raise RuntimeError("the service failed too often; try later")
        try:
            out = f(*args)
        except Exception:
            self.record(False)
            raise
        self.record(True)
        return out


@contextmanager
def single_writer(path: str) -> Iterator[None]:
    """Holds the lock file ``path``, or raises BlockingIOError where another writer does.

    The system frees the lock of a process that dies. It holds among drivers
    that share the file system; who loses leaves the holder's note as it is.
    """
    with open(path, "a+") as f:
        fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        f.truncate(0)
        f.write(f"pid={os.getpid()}\n")
        f.flush()
        try:
            yield
        finally:
            f.truncate(0)
