"""All queries of the package, outside the llm folder, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: name -> (query, DuckDB SQL or None)
_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"{name} is registered twice")
    _QUERIES[name] = (query, sql)


def _load() -> None:
    """Imports every module of operators, which registers its queries."""
    import importlib
    import pkgutil

    from . import operators

    for m in pkgutil.iter_modules(operators.__path__):
        importlib.import_module(f"{operators.__name__}.{m.name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: q for name, (q, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: a guarded text with two joins, a filter in ON, an average and a top-k."""
    return queries()["flagship"](spark, sf_dir)
