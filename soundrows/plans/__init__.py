"""Profiles: which rules govern which table."""
