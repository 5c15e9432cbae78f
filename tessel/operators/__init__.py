"""DataFrame operators: analysis, data quality, retrieval and governance."""
