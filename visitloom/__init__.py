"""Retail customer analytics as plain PySpark DataFrame transformations."""
