"""PySpark library for measuring, validating and cleaning tables."""
