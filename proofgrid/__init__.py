"""Benchmark-evidence analytics on Spark: audited fact tables in, evidence tables out."""
