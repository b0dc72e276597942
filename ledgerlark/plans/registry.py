"""All registered queries of the reporting jobs, with their SQL."""

from __future__ import annotations

from .standins import duck, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Register a function of (t) under its name; ``t(name)`` gives a table.  ``sql`` is the same in DuckDB, with ``{name}`` for tables."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if sql:
            SQL[f.__name__] = duck(sql)
        return f

    return add


import importlib  # noqa: E402
import importlib.util  # noqa: E402

for _part in ("retrieval", "drafts", "extraction", "reports", "deadlines", "tenancy", "structure", "chunks", "sources"):
    if importlib.util.find_spec(f"{__package__}.q_{_part}"):
        importlib.import_module(f"{__package__}.q_{_part}")


def flagship(spark, sf_dir: str):
    """Retrieval of benchmark passages: match, rank, keep the best, hit rate."""
    return QUERIES["retrieval_hit_rate"](spark, sf_dir)
