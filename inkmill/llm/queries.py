"""The subpackage's registered queries and their SQL. Each query module offers QUERIES and ORACLE."""

from __future__ import annotations

from importlib import import_module

MODULES = ("q01", "q02", "q03", "q04", "q05", "q06", "q07", "q08", "q09", "q10")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
