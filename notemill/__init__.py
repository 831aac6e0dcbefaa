"""notemill: clinical text analytics as Spark jobs."""
