"""Whole comparisons put together from the operators."""
