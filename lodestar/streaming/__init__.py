"""Micro-batch maintenance of the index tables."""
