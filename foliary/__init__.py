"""foliary: document collections to typed, normalised tables, as Spark jobs."""
