"""Column expressions without windows: numbers, moments, time, text of payloads."""
