"""Hourly air-quality analytics as Spark DataFrame transforms."""
