"""Spark jobs for news articles and standoff span annotations."""
