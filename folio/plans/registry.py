"""Named queries over the driver's tables, each with the SQL that must give the same rows where SQL can.

The reference's entities are projected from the tables: a document is a book, its id the slug, its language the
metadata's; part keys are assets; line items are fragments, their order number the chapter and their quantity the
duration; events are queue steps and job results; orders are runs of customers' books; conversations' turns are
what was expected and what was heard.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its oracle."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


from folio.plans import books, fragments, more, queue, sources, streams, texts  # noqa: E402, F401
