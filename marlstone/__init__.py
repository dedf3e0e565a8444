"""Spark-first analytics over a multi-tenant document corpus."""
