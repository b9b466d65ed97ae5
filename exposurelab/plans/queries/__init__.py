"""Registered queries: name -> (builder, SQL of the same meaning).

A builder takes ``Tables`` and returns a DataFrame.  The SQL runs on the same
tables in another engine; a query without SQL is checked by the unit tests.
"""

from importlib import import_module

from .registry import REGISTRY, Tables

for _name in ("effects", "matching", "posts", "exploring", "files", "texts"):
    import_module(f"{__name__}.{_name}")

__all__ = ["REGISTRY", "Tables"]
