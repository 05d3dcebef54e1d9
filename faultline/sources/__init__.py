"""Readers and writers: logs, documents, models, indexes, reports."""
