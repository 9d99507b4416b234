"""Operators of a training-data pipeline: filters, deduplication, mixing, packing and output.

Nothing else in the package imports this subpackage; it may be removed as a whole.
"""
