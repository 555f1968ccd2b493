"""Queries over the supplied tables, and the SQL that each is held against."""
