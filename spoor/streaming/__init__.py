"""Streaming twins of the batch jobs."""
