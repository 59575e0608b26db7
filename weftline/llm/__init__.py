"""Operators that prepare training text: deduplication, language, quality, mixing, tokens, archives.

Nothing else in the library imports this subpackage.
"""
