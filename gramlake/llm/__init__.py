"""Operators that prepare training text at scale: near-duplicate detection, scoring, filtering, mixing, tokenizing.

Nothing else in the library imports this subpackage.
"""
