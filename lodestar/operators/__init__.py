"""Relational operators: index building, search, skew-safe aggregation, record parsing."""
