"""Spark jobs for auditing and matching instructional text corpora."""
