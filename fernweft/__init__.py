"""Analytics operators expressed on Spark's DataFrame, SQL and streaming APIs."""

__version__ = "0.1.0"
