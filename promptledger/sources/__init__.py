"""Readers, writers and the pricing dimension."""
