"""The queries of this subpackage and their SQL; each operator's module has its own."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

#: Modules with QUERIES (name -> function of spark and folder) and ORACLES (name -> DuckDB SQL).
MODULES = ("minhash", "substrings", "packing", "decontaminate", "token_files", "lm", "pii", "language", "warc", "quality", "licences", "alignment", "negatives")


def _all(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"{__package__}.{name}"), what)
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": corpus_pipeline.run} | _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES") | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
