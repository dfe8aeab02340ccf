"""What a Python worker keeps between tasks: one thing at a time, so that stages do not add up in a long-lived worker."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import TypeVar

T = TypeVar("T")
_HELD: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], T]) -> T:
    """What was made under this key, or made now, everything else being let go."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]  # type: ignore[return-value]


def let_go() -> None:
    """Free what an earlier stage kept."""
    _HELD.clear()
