"""Streaming built on public Spark APIs."""
