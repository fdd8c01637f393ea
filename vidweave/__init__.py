"""Spark jobs over timestamped transcripts and the tables around them."""
