"""Readers, writers and file-version listings."""
