"""Indicator analytics on PySpark."""
