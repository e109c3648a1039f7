"""Relational operators over rules, violations, configuration and summaries."""
