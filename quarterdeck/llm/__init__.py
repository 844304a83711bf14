"""Operators for preparing training text: cleaning, filtering, de-duplication, scoring, encoding, packing, search."""
