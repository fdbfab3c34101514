"""Whole runs: read, work, store, report."""
