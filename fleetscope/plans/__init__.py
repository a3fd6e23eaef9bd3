"""Registered queries, each with the SQL that defines its result."""
