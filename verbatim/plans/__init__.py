"""Whole jobs over the operators."""
