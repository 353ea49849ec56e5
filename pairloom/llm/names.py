"""Names for columns that operators add."""

from __future__ import annotations


def free_name(columns: list[str], name: str) -> str:
    """``name``, or the first of ``name``_2, ``name``_3, ... that no column has, in upper or lower case."""
    taken, k, found = {c.lower() for c in columns}, 1, name
    while found.lower() in taken:
        k += 1
        found = f"{name}_{k}"
    return found
