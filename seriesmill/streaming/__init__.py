"""Continuous counterparts of bars, de-duplication, sessions and smoothing, by Structured Streaming."""
