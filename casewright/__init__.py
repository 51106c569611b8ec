"""Spark jobs for drug-safety case reports."""
