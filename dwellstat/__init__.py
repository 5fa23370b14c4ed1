"""Property-valuation and rating analytics expressed as Spark DataFrame jobs."""
