"""Spark-first analytics over case records, citations and text corpora."""
