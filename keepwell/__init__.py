"""keepwell: subscriber retention and brand reputation analytics as Spark jobs."""
