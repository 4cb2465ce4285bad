"""docweave: knowledge-base analytics as PySpark jobs over whole tables."""
