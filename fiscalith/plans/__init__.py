"""Composed analytics."""
