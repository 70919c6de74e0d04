"""Relational operators over events, nodes and links."""
