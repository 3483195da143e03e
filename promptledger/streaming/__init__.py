"""Structured Streaming forms of the ledger and scrub operators."""
