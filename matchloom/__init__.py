"""Document matching and training-data analytics as Spark jobs."""
