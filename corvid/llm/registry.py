"""The opN_ queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def _modules():
    """Modules query_*.py of this folder, each with NAME, run(spark, sf_dir) and ORACLE_SQL."""
    names = sorted(m.name for m in pkgutil.iter_modules([str(Path(__file__).parent)]) if m.name.startswith("query_"))
    return [importlib.import_module(f"corvid.llm.{n}") for n in names]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.NAME: m.run for m in _modules()}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.ORACLE_SQL for m in _modules() if m.ORACLE_SQL}
