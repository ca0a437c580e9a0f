"""Structured Streaming forms of the daily signal and of run ingestion."""
