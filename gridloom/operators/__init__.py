"""Operators over matrices, rows, points and residuals."""
