"""Document-collection analytics as Spark jobs."""
