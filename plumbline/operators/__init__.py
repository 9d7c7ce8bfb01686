"""Metric definitions and the Spark aggregations that compute them."""
