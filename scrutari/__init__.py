"""Full-text search and relevance ranking on Spark DataFrames."""
