"""Sources, ingestion and publication."""
