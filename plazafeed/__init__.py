"""City-feed analytics as Spark jobs."""
