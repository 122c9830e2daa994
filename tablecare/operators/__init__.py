"""Operators on tables: profiles, quality, issues, cleaning, validation, rules."""
