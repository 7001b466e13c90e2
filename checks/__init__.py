"""Queries over the generated tables, and the SQL they are checked against."""
