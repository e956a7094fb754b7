"""Structured Streaming forms of triage."""
