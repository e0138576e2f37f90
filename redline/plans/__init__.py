"""Whole comparisons."""
