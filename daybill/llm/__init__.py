"""Operators that prepare a training corpus: de-duplication, tokenising, screening, packing and search over whole tables."""
