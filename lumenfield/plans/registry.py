"""A query is a function of the tables, under a name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.derived import Tables, ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(*needs: str, sql: str | None = None):
    """Register the decorated function of ``Tables`` under its own name.  ``sql`` may name the derived tables in ``needs``."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            if needs:
                head = ctes(*needs)
                if body.startswith("WITH RECURSIVE "):
                    body = f"{head.replace('WITH', 'WITH RECURSIVE', 1)},\n{body[15:].lstrip()}"
                else:
                    body = f"{head},\n{body[5:].lstrip()}" if body.startswith("WITH ") else f"{head}\n{body}"
            ORACLES[f.__name__] = body
        return f

    return register
