"""Analytics of how new the statements of papers are, as Spark jobs."""
