"""Numerical kernels on NumPy arrays, used inside grouped functions."""
