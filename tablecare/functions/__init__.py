"""Column expressions: cells and their types, statistics, privacy."""
