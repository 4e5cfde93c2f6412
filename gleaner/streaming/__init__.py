"""Incremental paths: files as they arrive, and progress metrics over event time."""
