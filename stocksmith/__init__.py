"""stocksmith: inventory and order analytics as Spark DataFrame jobs.

Layout
------
sources/    table schemas, loaders, snapshot/audit sinks, test-table mapping
functions/  Column builders: predicates, labels, exact money arithmetic
operators/  DataFrame -> DataFrame operators: joins, aggregates, windows,
            paging, validation, state changes, stock allocation
plans/      reports and the registry of named queries with their SQL oracles
streaming/  Structured Streaming jobs (rate limits, request metrics, stock
            alerts, revoked-token use, status requests)
"""

__all__ = ["session"]
