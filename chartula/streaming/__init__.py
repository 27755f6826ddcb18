"""Structured Streaming wrappers around the batch jobs."""
