"""Incremental runs over folders that grow."""
