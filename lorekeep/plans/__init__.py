"""Queries composed of operators, and the SQL each is checked against."""
