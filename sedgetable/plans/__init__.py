"""Registered queries over the driver tables, each with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> dict[str, tuple[Query, str | None]]:
    from sedgetable.plans import (
        comparison, edits, findings, profiles, publishing, relationships, reviewed, search, sources, streams, suggestions, transforms, validation,
    )

    out: dict[str, tuple[Query, str | None]] = {}
    for module in (relationships, search, profiles, findings, suggestions, comparison, transforms, reviewed, validation, edits, sources, publishing, streams):
        for name, entry in module.entries().items():
            if name in out:
                raise ValueError(f"query registered twice: {name}")
            out[name] = entry
    return out
