"""Reusable DataFrame operators: lookups, blocking joins, rules, as-of joins."""
