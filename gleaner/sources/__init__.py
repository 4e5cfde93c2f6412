"""Readers and writers: files, the feature cache, the run journal and reports."""
