"""Every operator as a query over the given tables, with an SQL twin to check it by."""

from __future__ import annotations

from importlib import import_module

from textrec.queries.registry import QUERIES

for _name in ["columns", "screening", "classify", "logs", "transcripts", "tables", "inference", "findings", "scoring"]:
    import_module(f"textrec.queries.{_name}")

__all__ = ["QUERIES"]
