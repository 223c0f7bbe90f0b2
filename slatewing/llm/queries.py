"""The registered queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

import importlib

MODULES = ("warc", "quality", "suffixes", "neighbours", "packing", "chunks", "decontaminate", "licenses", "mixing", "simhash")


def catalogue() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"slatewing.llm.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
