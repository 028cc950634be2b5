"""Operators for record linkage and text corpora; nothing else in the package imports this."""
