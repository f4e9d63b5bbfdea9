"""Relational and model operators over read, call and feature tables."""
