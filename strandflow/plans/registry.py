"""All queries of the library by name, with their DuckDB equivalents."""

from __future__ import annotations

from strandflow.plans import adapters, alignments, intervals_runs, sequences, signals, traces  # noqa: F401  (they register their queries)


def queries() -> dict:
    return dict(adapters.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(adapters.ORACLES)
