"""Event logs as tables and streams."""
