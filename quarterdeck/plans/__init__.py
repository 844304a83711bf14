"""End-to-end feature tables built from the operators."""
