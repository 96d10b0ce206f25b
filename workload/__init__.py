"""Queries over the test tables, with the SQL that says what they must return."""
