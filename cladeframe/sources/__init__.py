"""Readers and writers of text forms."""
