"""Document-intelligence and retrieval analytics as set-at-a-time Spark jobs."""
