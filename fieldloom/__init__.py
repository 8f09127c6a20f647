"""Causal time-series analytics on Spark, keyed by site or sensor."""
