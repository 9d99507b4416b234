"""Schemas, readers, writers and the adapter for the warehouse test tables."""
