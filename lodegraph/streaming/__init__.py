"""Feeding graphs from streams."""
