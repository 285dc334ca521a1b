"""Structured Streaming entry points.

The reference has no streaming.  Its stateless operators (cleaning, row features,
prediction) accept a streaming DataFrame unchanged; these helpers wire them to a file
source and a sink, plus the one natural incremental aggregate: daily spend with a
watermark.
"""
from kassa.streaming.ledger_stream import categorize_stream, daily_spend_stream  # noqa: F401
