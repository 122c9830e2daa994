"""Registered queries of the table-quality operators, and cleaning plans."""
