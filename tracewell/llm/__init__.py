"""Operators for preparing training text: scans, deduplication, extraction, mixing, sharding.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
