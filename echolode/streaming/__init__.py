"""Incremental scans of arriving files."""
