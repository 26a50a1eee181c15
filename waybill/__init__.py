"""Delivery audit and operational-metric analytics on PySpark."""
