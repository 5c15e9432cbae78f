"""Spark-first analytics engine: governed metrics, analysis, quality checks and ingestion on DataFrames."""
