"""Prompt payload and spend-ledger analytics as PySpark DataFrame operations."""
