"""Queries over the library's tables, each beside the SQL that gives the same rows."""
