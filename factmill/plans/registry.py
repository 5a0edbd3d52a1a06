"""Every registered query of the fact engine with its DuckDB equivalent."""

from __future__ import annotations

from . import compositions, records, retrieval, serving, streams, tables

QUERIES: dict = {}
ORACLE: dict = {}
for _module in (records, retrieval, tables, compositions, serving, streams):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE


def flagship(spark, sf_dir):
    return QUERIES["question_answering"](spark, sf_dir)
