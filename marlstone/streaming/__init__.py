"""Streaming forms of metrics, and maintenance as micro-batches."""
