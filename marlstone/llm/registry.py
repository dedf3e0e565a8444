"""All queries of the subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("pii", "jaccard_join", "substring_dedup", "quality_rules", "toxicity", "quality_model", "decontaminate", "shard", "language", "pack", "filter_audit", "source_divergence", "url_filters")


def _merged(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"marlstone.llm.{m}"), name, {})
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE")
