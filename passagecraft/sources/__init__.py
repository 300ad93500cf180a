"""Readers of document files and of paged text."""
