"""Scalar functions, all as Column expressions (operators M1 to M17)."""
