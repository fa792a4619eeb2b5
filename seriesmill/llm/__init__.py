"""Operators that a training-data pipeline needs, one module each.

Nothing outside this subpackage imports it; ``queries.py`` holds the registered queries and their SQL.
"""
