"""Document-research analytics expressed as Spark DataFrame jobs."""
