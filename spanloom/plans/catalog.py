"""All queries of the library outside spanloom.llm, and their SQL."""

from __future__ import annotations

from spanloom.operators.search import page
from spanloom.plans import data_queries, span_queries
from spanloom.sources.fixtures import order_spans

QUERIES = {**span_queries.QUERIES, **data_queries.QUERIES}
SQL = {**span_queries.SQL, **data_queries.SQL}


def flagship(spark, sf_dir):
    """The newest server spans with an error."""
    got = page(order_spans(spark, sf_dir), {"kind": "server", "status": "error"})
    return got.select(*span_queries.COLS, "service_name")
