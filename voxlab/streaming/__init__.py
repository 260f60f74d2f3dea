"""Structured Streaming: scoring of arriving rows and running tallies."""
