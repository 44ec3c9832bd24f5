"""All queries of the record and time-series engine, with their SQL."""

from __future__ import annotations

from modelframe.plans import indicators, records, streams, timeseries

_PARTS = (records, timeseries, indicators, streams)


def queries():
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql():
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
