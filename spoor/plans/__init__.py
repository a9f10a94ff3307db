"""Registered queries, their inputs and the SQL that gives the same results."""
