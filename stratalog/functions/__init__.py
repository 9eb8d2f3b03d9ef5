"""Scalar helpers with fixed rounding and text rules."""

from .scalars import age_text, fnv1a, glob_regex, hundredths, query_key, singular, strip_comments, thousandths, thousandths_floor, tuple_hash

__all__ = ["age_text", "fnv1a", "glob_regex", "hundredths", "query_key", "singular", "strip_comments", "thousandths", "thousandths_floor", "tuple_hash"]
