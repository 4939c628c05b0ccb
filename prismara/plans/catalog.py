"""All catalogue queries and their oracle SQL."""

from . import answers, boxes, flows, pixels, reports, runs

_MODULES = (answers, boxes, flows, pixels, reports, runs)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.oracle_sql().items()}
