"""Expressions and pattern operators compiled to DataFrame operations."""
