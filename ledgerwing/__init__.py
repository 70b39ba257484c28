"""Governance analytics on Spark: decisions, events, audit logs and text corpora as DataFrames."""
