"""Readers of pages, Markdown, sidecar metadata and saved structures."""
