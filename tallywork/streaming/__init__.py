"""Continuous monitoring with Structured Streaming."""
