"""Registered queries: engine jobs over the driver tables, with their SQL twins."""
