"""Readers and writers: collections, query files, index tables, run files."""
