"""Causal operators on streams of readings."""
