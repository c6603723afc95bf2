"""sigmill: update-signal analytics expressed as Spark DataFrame jobs."""
