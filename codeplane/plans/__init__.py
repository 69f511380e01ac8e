"""Queries over the tables; importing the modules registers them."""

from importlib import import_module

from .registry import ORACLE, QUERIES

for _m in ("metrics", "ordered", "search", "code", "graph", "tables", "patches", "lookups"):
    try:
        import_module(f".{_m}", __name__)
    except ModuleNotFoundError as e:
        if e.name != f"{__name__}.{_m}":
            raise

__all__ = ["ORACLE", "QUERIES"]
