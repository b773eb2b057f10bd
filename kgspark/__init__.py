"""Documents, knowledge graphs and hybrid retrieval as Spark jobs."""
