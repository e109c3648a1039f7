"""Whole actions: run, rules and config, and where their results go."""
