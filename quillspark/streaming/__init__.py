"""Queries over unbounded sources.

A statement is a DataFrame, so one over a streaming DataFrame (`Store.dataframe(spark.readStream...)`) is a streaming
query; Spark rejects what it can't run incrementally. Nothing here adds to Structured Streaming but a short way to start.
"""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQuery

from ..plans.query import Query


def start(query: Query, sink: str, name: str, mode: str = "append", params: dict | None = None, **options) -> StreamingQuery:
    return query(params).writeStream.format(sink).queryName(name).outputMode(mode).options(**options).start()
