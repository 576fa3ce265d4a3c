"""Print matching, price reference and deal analytics as Spark jobs."""
