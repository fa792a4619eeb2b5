"""Operators over series: each takes a DataFrame and a Series and adds columns or aggregates."""
