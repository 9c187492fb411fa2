"""Continuous update of the daily and feature tables with Structured Streaming."""
