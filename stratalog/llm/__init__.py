"""Operators for preparing language-model training text.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
only where it is present.
"""
