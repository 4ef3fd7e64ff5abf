"""Plans built on public Spark APIs."""
