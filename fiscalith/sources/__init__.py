"""Readers, writers, and inference from paths and URLs."""
