"""Readers, writers and the graph view over the driver tables."""
