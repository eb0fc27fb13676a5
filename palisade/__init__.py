"""Spark-first static threat analytics for packages of text files."""
