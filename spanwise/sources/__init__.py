"""Readers, writers and the claims views over the driver tables."""
