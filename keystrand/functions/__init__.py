"""Typed keys and values."""
