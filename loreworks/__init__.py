"""Knowledge-corpus and activity-log analytics expressed as Spark jobs."""
