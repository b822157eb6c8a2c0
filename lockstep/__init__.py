"""Point-in-time event studies over daily market data, as Spark DataFrame jobs."""
