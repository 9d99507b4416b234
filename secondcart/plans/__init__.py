"""Whole studies put together from the operators, and the catalogue of named queries."""
