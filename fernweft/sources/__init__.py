"""Sources built on public Spark APIs."""
