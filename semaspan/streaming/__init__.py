"""Incremental runs over folders that keep receiving new corpus files."""
