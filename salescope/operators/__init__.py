"""Operators over the canonical sales table, logs, history and question text."""
