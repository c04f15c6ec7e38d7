"""Readers of raw readings and writers of results."""
