"""Tolerant HTML trees, selectors, main content and Markdown, in plain Python."""
