"""Functions built on public Spark APIs."""
