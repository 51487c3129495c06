"""Refreshing the index as notes arrive."""
