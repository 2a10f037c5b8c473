"""Sequence analytics as DataFrame transformations."""
