"""All queries of the library by name, each with the DuckDB text that gives the same rows where SQL can say it; its operators; and
the place where users add their own of both."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import scalars
from ..operators import aggregates, filters, graph, joins, learned, sets, sketch, sorts, vectors
from . import catalogue

Query = Callable[[SparkSession, str], DataFrame]
_OWN_QUERIES: dict[str, tuple[Query, str | None]] = {}
_OWN_OPERATORS: dict[str, tuple[Callable, str]] = {}
MODULES = {m.__name__.rsplit(".", 1)[1]: m for m in (filters, joins, aggregates, sorts, sets, scalars, vectors, graph, learned, sketch)}


def register_query(name: str, query: Query, oracle: str | None = None) -> None:
    """Add a query (spark, folder) -> DataFrame of one's own; a name that is taken raises."""
    if name in catalogue.QUERIES or name in _OWN_QUERIES:
        raise ValueError(f"there is a query {name!r}")
    _OWN_QUERIES[name] = query, oracle


def register_operator(name: str, operator: Callable, category: str = "own") -> None:
    """Add an operator of one's own, which ``operator`` finds by name; a name that is taken raises."""
    if name in _operators():
        raise ValueError(f"there is an operator {name!r}")
    _OWN_OPERATORS[name] = operator, category


def unregister(name: str) -> None:
    """Take a query or operator of one's own out again."""
    _OWN_QUERIES.pop(name, None)
    _OWN_OPERATORS.pop(name, None)


def _operators() -> dict[str, tuple[Callable, str]]:
    found = {}
    for category, module in MODULES.items():
        for name, thing in vars(module).items():
            if callable(thing) and not name.startswith("_") and getattr(thing, "__module__", None) == module.__name__:
                found[f"{category}.{name}"] = thing, category
    return found | _OWN_OPERATORS


def operator(name: str) -> Callable:
    return _operators()[name][0]


def operators(spark: SparkSession) -> DataFrame:
    """(name, category, parameters, says) of all operators."""
    rows = [(name, category, str(inspect.signature(thing)), (inspect.getdoc(thing) or "").split("\n\n")[0].replace("\n", " ")) for name, (thing, category) in sorted(_operators().items())]
    return spark.createDataFrame(rows, "name string, category string, parameters string, says string")


def queries() -> dict[str, Query]:
    return dict(catalogue.QUERIES) | {name: query for name, (query, _) in _OWN_QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(catalogue.ORACLES) | {name: oracle for name, (_, oracle) in _OWN_QUERIES.items() if oracle is not None}
