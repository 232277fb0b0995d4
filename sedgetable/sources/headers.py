"""Header names made unique."""

from __future__ import annotations

from collections.abc import Sequence

from sedgetable.core import TableError


def unique_headers(names: Sequence[str], strip: bool = True, width: int | None = None) -> list[str]:
    """Blank names become ``column_i`` and repeats get ``_2``, ``_3`` …; stripping is for strict scans only."""
    width = width or len(names)
    if width < 1:
        raise TableError("a table has at least one column")
    out: dict[str, None] = {}
    for i in range(width):
        name = names[i] if i < len(names) and names[i] is not None else ""
        base = (name.strip() if strip else name) or f"column_{i + 1}"
        candidate, k = base, 2
        while candidate in out:
            candidate, k = f"{base}_{k}", k + 1
        out[candidate] = None
    return list(out)
