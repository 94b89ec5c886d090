"""transitweave: transit analytics and routing as Spark jobs."""
