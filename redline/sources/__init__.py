"""Readers and reply parsers."""
