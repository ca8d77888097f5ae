"""What a Python worker keeps from one task to the next."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle

#: Objects that a worker process keeps at once; a model is large, and a run uses one.
KEPT = 1
_HELD: dict[str, Any] = {}


def key_of(factory: Callable) -> str:
    """Name of a factory with all it holds on to, such as the settings it was given."""
    return hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()


def held(key: str, factory: Callable[[], Any], kept: int = KEPT) -> Any:
    """What ``factory`` gives, made once in this worker process for all tasks that ask for the same key.

    Beyond ``kept`` objects the one that was made first goes; its ``close`` method is called if it has one.
    """
    if key not in _HELD:
        while len(_HELD) >= kept:
            gone = _HELD.pop(next(iter(_HELD)))
            close = getattr(gone, "close", None)
            if callable(close):
                close()
        _HELD[key] = factory()
    return _HELD[key]
