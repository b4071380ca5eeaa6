"""Whole queries: the scan engine and the named queries."""
