"""Helpers that shape physical work: shared storage, ordered scans."""
