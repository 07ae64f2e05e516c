"""Linting of texts as they arrive."""
