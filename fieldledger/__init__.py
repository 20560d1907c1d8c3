"""Observational analytics over field reports, expressed as Spark DataFrame jobs."""
