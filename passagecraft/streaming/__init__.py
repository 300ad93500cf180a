"""Extension: incremental ingest with Structured Streaming."""
