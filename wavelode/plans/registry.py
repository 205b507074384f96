"""All queries of the library's own operators by name, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import columns, kernels, packets, samples, streams

_MODULES = (packets, samples, streams, kernels, columns)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {n: f for m in _MODULES for n, f in vars(m).items() if n[:1] == "q" and n[1:3].isdigit() and callable(f)}
    return dict(sorted(found.items()))


def oracle_sql() -> dict[str, str]:
    return {n: sql for m in _MODULES for n, sql in m.ORACLE.items()}
