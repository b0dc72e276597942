"""Spark jobs for grant-reporting data and training-data preparation."""
