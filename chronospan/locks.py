"""An advisory lock for single writers: a file made exclusively, stale after some hours.

It guards the machines that see the file, so it lies beside the tables.
"""

from __future__ import annotations

import contextlib
import os
import time
import uuid
from collections.abc import Iterator
from pathlib import Path

STALE_S = 6 * 3600


class Locked(RuntimeError):
    """Another writer holds the lock."""


@contextlib.contextmanager
def lock(path: str, force: bool = False, stale: float = STALE_S) -> Iterator[None]:
    """Holds ``path``; a lock older than ``stale`` seconds, or any with ``force``, is taken over."""
    own = Path(path)
    with contextlib.suppress(FileNotFoundError):
        if force or time.time() - own.stat().st_mtime > stale:
            own.unlink()
    try:
        handle = os.open(own, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    except FileExistsError as e:
        raise Locked(f"{path} is held by {own.read_text().strip() or 'another writer'}") from e
    mark = f"process {os.getpid()} {uuid.uuid4().hex}"
    try:
        with os.fdopen(handle, "w") as f:
            f.write(mark)
        yield
    finally:
        with contextlib.suppress(FileNotFoundError):
            if own.read_text() == mark:  # another writer may have taken the lock over
                own.unlink()
