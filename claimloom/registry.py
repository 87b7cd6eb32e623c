"""All registered queries of the reference's operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from claimloom.plans import carriers, ledgers, library, records, revisions, scopes, statements, structures, typed  # noqa: F401  each module adds its queries to the carriers' tables


def queries() -> dict[str, Callable]:
    return dict(carriers.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(carriers.SQL)
