"""Point-in-time market and event analytics as Spark jobs."""
