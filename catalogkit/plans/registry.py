"""All registered queries of the library."""

from __future__ import annotations

from . import content, dictionaries, feeds, harvests, people, pictures, records, scalars, tables, verification, weekly, writes  # noqa: F401
from .base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
