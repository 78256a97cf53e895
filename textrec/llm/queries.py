"""One query per operator over the given tables, with its SQL twin where SQL can express it."""

from __future__ import annotations

from importlib import import_module

from textrec.llm.registry import QUERIES

NAMES = ["dedup", "data", "text", "runs", "vectors"]

for _name in NAMES:
    import_module(f"textrec.llm.query_{_name}")

__all__ = ["QUERIES"]
