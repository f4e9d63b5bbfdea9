"""Queries that compose the operators, and the command line."""
