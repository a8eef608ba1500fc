"""Operators: DataFrame in, DataFrame out, columns as in the canonical tables."""
