"""Streaming forms of batch operators (an extension)."""
