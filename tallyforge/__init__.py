"""Usage analytics on Spark: usage events from session logs, queries, streams and sinks."""
