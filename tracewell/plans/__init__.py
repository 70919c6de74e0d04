"""Whole analyses made of operators, and the queries over the driver tables."""
