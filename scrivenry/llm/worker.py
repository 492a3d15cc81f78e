"""What a Python worker keeps between batches and tasks."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

_HELD: dict[Hashable, Any] = {}


def held(key: Hashable, build: Callable[[], Any]) -> Any:
    """What ``build`` returns, kept until another key is asked for: a worker holds one operator's structures only."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]
