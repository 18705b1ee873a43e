"""Join helpers."""

from __future__ import annotations

from collections.abc import Iterable


def unused_name(base: str, taken: Iterable[str]) -> str:
    """``base``, with underscores added until no column in ``taken`` has it."""
    names = {c.lower() for c in taken}
    while base.lower() in names:
        base += "_"
    return base
