"""Structured Streaming variants of the timeline operators."""
