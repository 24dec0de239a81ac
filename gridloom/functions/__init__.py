"""Column expressions and small numpy kernels."""
