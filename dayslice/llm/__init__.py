"""Operators for language-model training data: scoring, packing, de-duplication, filters, search."""
