"""triplens: Spark jobs that audit, clean and summarise trip-billing tables."""
