"""Readers that turn statement files and tables into transaction rows."""
