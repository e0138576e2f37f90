"""Annotation tables, document rewriting, webhooks."""
