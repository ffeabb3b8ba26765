"""Incremental preparation and scoring with Structured Streaming."""
