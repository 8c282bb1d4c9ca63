"""How queries are told apart: a name, the SQL with the same rows, and the function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        """Decorator: the function (spark, sf_dir) becomes the query ``name``."""

        def keep(f: Callable) -> Callable:
            self.queries[name] = f
            if sql:
                self.oracles[name] = sql
            return f

        return keep


def as_text(name: str) -> Column:
    return F.col(name).cast("string").alias(name)


def pct_sql(n: str, d: str) -> str:
    return f"round((({n})::DECIMAL(20,4) * 100)::DECIMAL(30,4)::DOUBLE / nullif({d}, 0), 2)"


def mean_sql(total: str, n: str, places: int = 2) -> str:
    return f"round(({total})::DOUBLE / ({n}), {places})"
