"""Operators built on public Spark APIs."""
