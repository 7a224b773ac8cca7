"""Incremental refresh of landed files."""
