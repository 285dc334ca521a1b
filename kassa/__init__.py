"""kassa: ledger analytics as Spark DataFrame operators.

Sub-packages
------------
sources    readers for ledger files, test-data views and model tables, plus sinks
functions  column-level helpers (calendar, amounts, text, formatting)
operators  DataFrame -> DataFrame operators (cleaning, windows, aggregates, models ...)
plans      the registry of named queries and their DuckDB oracle SQL
streaming  Structured Streaming wrappers around the stateless operators
"""

__version__ = "0.1.0"
