"""Whole queries over the driver's tables and the SQL that says the same."""
