"""Scalar functions and extraction of facts from URLs, markup and text."""
