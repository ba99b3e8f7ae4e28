"""Imports every module that registers a query."""

from . import MODULES
from .registry import QUERIES, SQL

for _module in MODULES:
    __import__(f"{__package__}.{_module}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
