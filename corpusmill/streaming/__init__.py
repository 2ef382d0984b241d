"""Streaming forms of operators (an extension: the specification has none)."""
